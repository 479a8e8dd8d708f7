"""Data-quality contracts: each rule is one row (rule, subject, ok, n, detail)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import FORWARD_RETURN


def _row(df: DataFrame, rule: str, subject: str, n: Column, ok: Column) -> DataFrame:
    return df.agg(n.alias("n"), ok.alias("ok")).select(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tidy_rules(df: DataFrame, subject: str, as_of: str, max_age: int, min_entities: int) -> DataFrame:
    """Non-empty, no NULL keys, finite values, unique keys, recent, enough entities; one
    aggregate for the row rules and one for the keys."""
    bad_key = F.col("date").isNull() | F.col("entity").isNull() | F.col("variable").isNull()
    bad_val = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    a = df.agg(
        F.count("*").alias("rows"), F.count(F.when(bad_key, 1)).alias("null_keys"), F.count(F.when(bad_val, 1)).alias("bad_values"),
        F.max("date").alias("last"), F.countDistinct("entity").alias("entities"))
    k = df.groupBy("date", "entity", "variable").count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("duplicates"))
    j = a.join(k)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last"))
    rules = [("not_empty", F.col("rows"), F.col("rows") > 0), ("null_keys", F.col("null_keys"), F.col("null_keys") == 0), ("bad_values", F.col("bad_values"), F.col("bad_values") == 0),
             ("duplicates", F.col("duplicates"), F.col("duplicates") == 0), ("recency", age, age <= max_age), ("coverage", F.col("entities"), F.col("entities") >= min_entities)]
    arr = F.array(*[F.struct(F.lit(n).alias("rule"), v.cast("long").alias("n"), c.alias("ok")) for n, v, c in rules])
    return j.select(F.explode(arr).alias("r")).select("r.rule", F.lit(subject).alias("subject"), F.coalesce("r.ok", F.lit(False)).alias("ok"), "r.n")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], subject: str) -> DataFrame:
    """Key sets of two tables agree."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full")
    off = F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1))
    return _row(x, "aligned_keys", subject, off, off == 0)


def schema_rule(df: DataFrame, expected: dict[str, str], subject: str) -> DataFrame:
    """Column names and types match the declared contract."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    off = [c for c in set(have) | set(expected) if have.get(c) != expected.get(c)]
    return df.sparkSession.range(1).select(F.lit("schema").alias("rule"), F.lit(subject).alias("subject"), F.lit(not off).alias("ok"), F.lit(len(off)).cast("long").alias("n"))


def returns_first(df: DataFrame, banned_sources: Sequence[str], subject: str) -> DataFrame:
    """Optimizer output and forward returns never re-enter the inputs."""
    bad = F.count(F.when(F.col("source").isin(*banned_sources) | F.col("variable").rlike(FORWARD_RETURN), 1))
    return _row(df, "returns_first", subject, bad, bad == 0)


def event_rules(df: DataFrame, categories: Sequence[str], subject: str = "events") -> DataFrame:
    """Unique ids, known categories, severity 1..5, end not before start."""
    a = df.agg(
        (F.count("*") - F.countDistinct("event_id")).alias("duplicate_ids"), F.count(F.when(~F.col("category").isin(*categories), 1)).alias("unknown_category"),
        F.count(F.when(~F.col("severity").between(1, 5), 1)).alias("bad_severity"), F.count(F.when(F.col("end_date") < F.col("event_date"), 1)).alias("end_before_start"))
    names = ("duplicate_ids", "unknown_category", "bad_severity", "end_before_start")
    arr = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n")) for n in names])
    return a.select(F.explode(arr).alias("r")).select("r.rule", F.lit(subject).alias("subject"), (F.col("r.n") == 0).alias("ok"), "r.n")
