"""Projections, name rules and key mappings."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIDY = ("date", "entity", "value", "variable", "source")
FORWARD_RETURN = r"(?i)^\s*\d+\s*[MD]\s*Ret\s*$"


def unified(panels: dict[str | None, DataFrame] | Sequence[tuple[str | None, DataFrame]]) -> DataFrame:
    """Union of panels in the tidy shape; a named panel gets its constant source."""
    items = panels.items() if isinstance(panels, dict) else panels
    out = None
    for name, df in items:
        d = df if name is None else df.withColumn("source", F.lit(name))
        d = d.select(*TIDY)
        out = d if out is None else out.unionByName(d)
    return out


def numeric_only(df: DataFrame, value: str = "value") -> DataFrame:
    """Drop rows whose value is not a number."""
    return df.withColumn(value, F.col(value).try_cast("double")).filter(F.col(value).isNotNull())


def in_universe(df: DataFrame, universe: DataFrame, key: str = "entity") -> DataFrame:
    return df.join(universe.select(key).distinct(), key, "left_semi")


def derived_series_name(prefix: str, code: Column, feature: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(code), F.lit("_"), F.upper(feature))


def parse_names(df: DataFrame, variable: str = "variable") -> DataFrame:
    """Base variable and normalisation kind from the ``_CS`` / ``_TS`` suffix."""
    kind = F.lower(F.regexp_extract(variable, r"_(CS|TS)$", 1))
    return df.withColumns(
        {
            "base_variable": F.regexp_replace(variable, r"_(CS|TS)$", ""),
            "normalization": F.when(kind != "", kind).otherwise("raw"),
        }
    )


def longest_prefix(df: DataFrame, families: dict[str, str], variable: str = "variable", out: str = "family") -> DataFrame:
    """Family of the longest matching prefix; an unclassified variable raises when read."""
    return df.withColumn(out, longest_prefix_expr(F.col(variable), families))


def longest_prefix_expr(variable: Column, families: dict[str, str]) -> Column:
    rule = None
    for prefix in sorted(families, key=lambda p: (-len(p), p)):
        hit, fam = variable.startswith(prefix), F.lit(families[prefix])
        rule = F.when(hit, fam) if rule is None else rule.when(hit, fam)
    return rule.otherwise(F.raise_error(F.concat(F.lit("unclassified variable: "), variable)))


def keyword_category(text: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """First matching (regex, category) in order."""
    rule = None
    for pattern, cat in rules:
        rule = F.when(text.rlike(pattern), cat) if rule is None else rule.when(text.rlike(pattern), cat)
    return rule.otherwise(default)


# Which name stands for a code carried by several names.
ROLE_PRIORITY = {"sovereign_proxy": 0, "sovereign": 1, "market_sleeve": 2}


def canonical_names(df: DataFrame, code: str = "code", name: str = "name", role: str = "role") -> DataFrame:
    """One canonical name per code by role priority, then name, with all variants in order."""
    pr = F.create_map(*[x for k, v in ROLE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    key = F.struct(F.coalesce(pr[F.col(role)], F.lit(99)).alias("p"), F.col(name).alias("n"))
    d = df.select(code, name, role, key.alias("_k"))
    sleeves = F.array_sort(F.collect_set(F.when(F.col(role) == "market_sleeve", F.col(name))))
    return d.groupBy(code).agg(
        F.min_by(name, "_k").alias("entity"),
        F.min_by(role, "_k").alias("role"),
        F.transform(F.array_sort(F.collect_set("_k")), lambda k: k["n"]).alias("variants"),
        F.countDistinct(name).alias("variant_count"),
        sleeves.alias("market_sleeves"),
    )


def fan_out(df: DataFrame, mapping: DataFrame, code: str = "code") -> DataFrame:
    """Rows of a code repeated for every name the code maps to; unmapped codes drop out."""
    return df.join(mapping, code)


def remap(df: DataFrame, mapping: dict[str, str] | DataFrame, key: str = "entity") -> DataFrame:
    """Rename labels; those without an entry pass through."""
    if isinstance(mapping, dict):
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return df.withColumn(key, F.coalesce(m[F.col(key)], F.col(key)))
    m = mapping.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return df.join(m, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")


def month_align(d: Column) -> Column:
    """A month-end date labels the following month; any other date its own month."""
    return F.when(d == F.last_day(d), F.add_months(F.trunc(d, "month"), 1)).otherwise(F.trunc(d, "month"))


def complete_months(df: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """Drop the running month of ``as_of`` and keep each key's last row per month."""
    d = df.filter(F.trunc("date", "month") < F.trunc(F.lit(as_of).cast("date"), "month"))
    d = d.withColumn("month", F.trunc("date", "month"))
    w = Window.partitionBy(*keys, "month").orderBy(F.col("date").desc())
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def allow_listed(df: DataFrame, allowed: Sequence[str], table: str, tables: dict[str, Sequence[str]]) -> DataFrame:
    """Outcome-blind projection: a table or column off its allow-list is refused."""
    if table not in tables:
        raise ValueError(f"table {table!r} is not on the allow-list")
    extra = [c for c in allowed if c not in tables[table]]
    if extra:
        raise ValueError(f"columns {extra} of {table!r} are not on the allow-list")
    return df.select(*allowed)


def strip_payload_keys(payload: Column, forbidden: str) -> Column:
    """Remove every JSON object member whose key matches ``forbidden``, at any depth.

    Works on the text of the payload: members with scalar, array or object values are cut
    out innermost first, so nested members vanish with or before their parent.
    """
    scalar = r'(?:"(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false|null|\[[^\[\]{}]*\]|\{[^{}]*\})'
    member = r'"(?:' + forbidden + r')"\s*:\s*' + scalar
    out = payload
    for _ in range(4):
        out = F.regexp_replace(out, r",\s*" + member, "")
        out = F.regexp_replace(out, member + r"\s*,?\s*", "")
    return out


def refuse_forward_returns(variable: str) -> str:
    """Plan-time guard: a forward return may not be used as a signal."""
    import re

    if re.match(FORWARD_RETURN, variable):
        raise ValueError(f"{variable!r} is a forward return, not a signal")
    return variable


def without_forward_returns(df: DataFrame, variable: str = "variable") -> DataFrame:
    return df.filter(~F.col(variable).rlike(FORWARD_RETURN))


def without_sources(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    return df.filter(~F.col("source").isin(*sources))


def candidate_slots(available: DataFrame, slots: Sequence[tuple[str, str, int]]) -> DataFrame:
    """First available candidate variable per feature slot: (slot, candidate, priority).

    The slot list is written in code, so it is a literal of known size.
    """
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(c).alias("variable"), F.lit(p).alias("priority")) for s, c, p in slots])
    spark = available.sparkSession
    table = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return (
        available.select("variable").distinct()
        .join(F.broadcast(table), "variable")
        .groupBy("slot")
        .agg(F.min_by("variable", "priority").alias("variable"), F.min("priority").alias("priority"))
    )


def keep_listed_columns(wide: DataFrame, keep: dict[str, str], ids: Sequence[str]) -> DataFrame:
    """Wide feature table -> tidy rows of the listed columns under their short names."""
    have = [c for c in wide.columns if c in keep]
    d = wide.select(*ids, *[F.col(c).cast("double").alias(keep[c]) for c in have])
    return d.unpivot(list(ids), [keep[c] for c in have], "variable", "value").filter(F.col("value").isNotNull())


def sign_metadata(df: DataFrame, inverted: Sequence[str], frequency: dict[str, str]) -> DataFrame:
    """Direction sign and native frequency per variable."""
    f = F.create_map(*[x for k, v in frequency.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumns(
        {
            "sign": F.when(F.col("base_variable").isin(*inverted), -1).otherwise(1),
            "frequency": F.coalesce(f[F.col("source")], F.lit("monthly")),
        }
    )


# Contract question patterns in order of precedence: (pattern, class, direction).
QUESTION_RULES = (
    (r"(?i)(?:all[- ]time high|new high)", "all_time_high", "up"),
    (r"(?i)(?:close|finish|settle)s?\s+(?:above|over|higher than)", "close_above", "up"),
    (r"(?i)(?:close|finish|settle)s?\s+(?:below|under|lower than)", "close_below", "down"),
    (r"(?i)(?:reach|hit|touch)\w*\s.*\(?high\)?", "touch_high", "up"),
    (r"(?i)(?:dip|fall|drop)s?\s+(?:to|below)", "touch_low", "down"),
    (r"(?i)(?:up or down)", "up_or_down", "up"),
)


def parse_question(df: DataFrame, text: str = "question", price: str = "probability") -> DataFrame:
    """Contract question -> class, ticker, target and direction; others are dropped.

    The aligned price rises with the asset: questions paying on a fall are inverted.
    """
    kind = direction = None
    for pattern, cls, way in QUESTION_RULES:
        hit = F.col(text).rlike(pattern)
        kind = F.when(hit, cls) if kind is None else kind.when(hit, cls)
        direction = F.when(hit, way) if direction is None else direction.when(hit, way)
    target = F.regexp_replace(F.regexp_extract(text, r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    return (
        df.withColumns(
            {
                "question_class": kind,
                "direction": direction,
                "ticker": F.regexp_extract(text, r"\(([A-Z]{1,6})\)", 1),
                "target": F.when(target != "", target.cast("double")),
            }
        )
        .filter(F.col("question_class").isNotNull() & (F.col("ticker") != ""))
        .withColumn(
            "aligned_price", F.when(F.col("direction") == "down", 1 - F.col(price)).otherwise(F.col(price))
        )
    )


def listable(text: Column, banned: str = r"(?i)\b(war|strike|invade|invasion|terror\w*|assassinat\w*|military)\b") -> Column:
    return ~text.rlike(banned)
