"""URL filters: pattern rules found by their rarest literal token.

Every rule is a regular expression over ``host || path`` with the literal tokens (runs of
ASCII letters and digits, lower case) that any URL it fits must hold.  The rule is indexed
by that one of its tokens which the fewest URLs hold; a URL fetches rules by its own tokens
in an equi join, and only the fetched rules run their expression.  All of it is column
functions, joins and grouped maxima.
"""
from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, apart

RULE_SCHEMA = "rule string, action string, pattern string, tokens array<string>, listed int, weight int"
#: Token of rules without a literal of their own; every URL holds it.
ANY = ""

#: The contract's host and path rules.
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of hosts and of file or page names that the general patterns block.
HOST_WORDS = ("adult", "porn", "xxx", "sex", "casino", "betting", "poker", "viagra", "escort", "warez")
PATH_WORDS = ("login", "signin", "signup", "logout", "checkout", "cart", "unsubscribe")
FILE_ENDS = ("jpg", "jpeg", "png", "gif", "css", "js", "zip", "exe", "mp3", "mp4", "avi", "iso")


def listed_rule(action: str, host: str, path: str) -> tuple:
    """A rule for a host, its subdomains and all paths that start with ``path``."""
    text = host + path
    whole = re.findall(r"[A-Za-z0-9]+(?![A-Za-z0-9]|$)", text)  # the last run may go on in a URL
    pattern = r"(?s)^(?:[^/]*\.)?" + java_quote(host) + java_quote(path)
    return text, action, pattern, [t.lower() for t in whole], 1, len(text)


def java_quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", s)


def pattern_rule(name: str, pattern: str, token: str, action: str = "block") -> tuple:
    """A general rule; it yields to every listed rule."""
    return name, action, pattern, [token], 0, len(pattern)


def general_rules() -> list[tuple]:
    out = [pattern_rule(f"host:{w}", rf"^(?:[^/]*[.-])?{w}(?:[.-]|/|$)", w) for w in HOST_WORDS]
    out += [pattern_rule(f"path:{w}", rf"(?i)/{w}(?:[/.]|$)", w) for w in PATH_WORDS]
    return out + [pattern_rule(f"file:{w}", rf"(?i)/[^/]*\.{w}$", w) for w in FILE_ENDS]


def rule_table(spark: SparkSession, listed: Iterable[tuple] = LISTED, general: Iterable[tuple] | None = None) -> DataFrame:
    rows = [listed_rule(*r) for r in listed] + list(general_rules() if general is None else general)
    return spark.createDataFrame(rows, RULE_SCHEMA)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract defines them; both empty for NULL or no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@apart("url")
def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule, pattern and verdict to every row.

    Listed rules win over general ones; among listed rules the longest text wins, among
    general ones the longest expression; equal lengths go to block, then to the smaller
    name.  Without a fitting rule the verdict is allow.  ``rule`` names a listed rule,
    ``pattern`` a general one; either may be NULL.

    A verdict depends on the URL alone, so each distinct URL is judged once and joined back:
    repeated rows stay repeated, other columns pass through, input columns named like an
    output are replaced.  NULL, empty and odd URLs have empty host and path.  An empty rule
    table allows everything; an empty input gives no rows.  A very common URL is one row
    before any join, and the join back has the many rows on the side that AQE splits.
    """
    host, path = host_and_path(F.col("_url"))
    urls = df.select(F.col(url).alias("_url")).distinct()
    text = F.concat(host, path)
    words = F.array_distinct(F.concat(F.array(F.lit(ANY)), F.split(ascii_lower(text), r"[^a-z0-9]+")))
    tokens = urls.select("_url", text.alias("_t"), F.explode(words).alias("_w"))

    r = rules.withColumn("_all", F.array_distinct(F.concat(F.array(F.lit(ANY)), F.coalesce("tokens", F.array()))))
    wanted = r.select(F.explode("_all").alias("_w")).distinct()
    seen = tokens.join(wanted, "_w", "left_semi").groupBy("_w").count()
    by_token = r.withColumn("_w", F.explode("_all")).join(seen, "_w", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.when(F.col("_w") == ANY, 1).otherwise(0).alias("any"), F.col("_w").alias("w")))
    index = by_token.groupBy("rule", "action", "pattern", "listed", "weight").agg(rarest["w"].alias("_w"))

    fits = tokens.join(index, "_w").filter(F.regexp_like("_t", F.col("pattern")))
    order = F.struct(
        F.col("listed").alias("l"), F.col("weight").alias("n"), (F.col("action") == "block").cast("int").alias("b"),
    )
    # The smallest name among equals: the key is compared first, then the name in reverse.
    best = fits.groupBy("_url", order.alias("_o")).agg(F.min_by(F.struct("rule", "action", "listed"), "rule").alias("_r"))
    best = best.groupBy("_url").agg(F.max_by("_r", "_o").alias("_r"))
    best = best.select(F.col("_url").alias("_judged"), "_r")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")]
    rows = df.select(*keep, F.col(url).alias("_url")).join(best, F.col("_url") == F.col("_judged"), "left")
    return rows.select(
        *keep, host.alias("host"), path.alias("path"),
        F.when(F.col("_r.listed") == 1, F.col("_r.rule")).alias("rule"),
        F.when(F.col("_r.listed") == 0, F.col("_r.rule")).alias("pattern"),
        F.coalesce(F.col("_r.action"), F.lit("allow")).alias("verdict"),
    )
