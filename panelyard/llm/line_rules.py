"""Quality rules, line first: judge lines, remove the failing ones, then judge the rest.

Everything is column functions on one row: no shuffle, no Python.  Word windows are compared
as 64-bit hashes inside one text only; texts without a repeated window never sort.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Phrases of legal, consent and sharing lines, matched without regard to case.
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the|is licensed under|terms of (use|service)|privacy policy"
    r"|cookie (policy|settings)|we use cookies|subscribe to our|newsletter|share this|sign up|log ?in to|read more"
    r"|click here|copyright|\(c\) \d{4}|©|lorem ipsum|javascript)"
)
NAVIGATION = r"(?i)^[\s>»«|·•-]*(home|menu|next|previous|back|top|contact|about|search|login|sitemap)([\s>»«|/·•-]+\S{1,20}){0,8}[\s>»«|·•-]*$"


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules; shares are of the line's or the text's non-space characters."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_share: float = 0.10
    bar_share: float = 0.20
    shout_share: float = 0.60
    lost_share: float = 0.50


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def line_fails(line: Column, lim: Limits) -> Column:
    """Punctuation, navigation and boilerplate rules for one line.

    Symbols: more than ``symbol_share`` of the line is of #*$%&|<>, or bars stand between
    more than ``bar_share`` of its words.  Shouting: four or more words, most of its
    characters capitals or exclamation marks.  Navigation: a short trail of menu words.
    Boilerplate: a short line with a legal, consent or sharing phrase.  A blank line passes.
    """
    n = F.length(squeezed(line))
    n_words = F.size(F.split(line, SPACE))
    symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
    bars = F.length(F.regexp_replace(line, r"[^|]+", ""))
    loud = F.length(F.regexp_replace(line, r"[^\p{Lu}!]+", ""))
    return (
        (symbols > n * lim.symbol_share)
        | (bars > n_words * lim.bar_share)
        | ((n_words >= 4) & (loud > n * lim.shout_share))
        | ((F.length(line) <= 160) & (line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)))
    ) & (n > 0)


@apart("text")
def quality_rules(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned_text, lost_share and kept to every row.

    A text is kept if the base rules pass (at least ``min_words`` words, at most
    ``repeat_percent`` percent of them in repeated 3-word windows) and its failing lines and
    repeated lines after their first hold at most ``lost_share`` of its non-space characters.  NULL counts as an
    empty text and fails; repeated rows and other columns pass through, input columns named
    like an output are replaced.  Long texts are whole rows of one task.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned_text", "lost_share", "kept"]
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]
    d = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = d.select(*keep, "_text", F.array_remove(F.split("_text", SPACE), "").alias("_w"), F.split("_text", "\n").alias("_l"))
    d = d.withColumn(
        "_g",
        F.when(
            F.size("_w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("_full", F.filter("_l", lambda x: F.length(squeezed(x)) > 0))
    d = d.withColumn("_one", F.array_distinct("_full"))

    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.expr("filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false) or coalesce(x.h = get(_s, k + 1).h, false))")
    d = d.withColumn("_r", F.transform(again, lambda x: x["i"]))
    d = d.withColumn("_r", F.size(F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2))))))
    n, rep = F.size("_w").cast("long"), F.coalesce(F.when(F.col("_s").isNotNull(), F.col("_r")), F.lit(0)).cast("long")
    good = F.filter("_one", lambda x: ~line_fails(x, limits))
    d = d.select(
        *keep,
        n.alias("n_words"),
        F.length(squeezed(F.col("_text"))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size("_one")).cast("long").alias("n_dup_lines"),
        rep.alias("n_repeat_words"),
        ((n < limits.min_words) | (100 * rep > limits.repeat_percent * n)).alias("base_failed"),
        F.array_join(good, "\n").alias("cleaned_text"),
    )
    lost = 1 - F.length(squeezed(F.col("cleaned_text"))) / F.greatest(F.col("word_chars"), F.lit(1))
    return d.withColumn("lost_share", lost).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= limits.lost_share))
