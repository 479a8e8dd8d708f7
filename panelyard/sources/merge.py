"""Batch merges and sinks: what replaces what when a new batch arrives."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_sources(existing: DataFrame, fresh: DataFrame, ok_sources: DataFrame) -> DataFrame:
    """Slices of the sources that succeeded are replaced; all others stay as they are."""
    kept = existing.join(ok_sources.select("source").distinct(), "source", "left_anti")
    return kept.unionByName(fresh)


def upsert(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win by key; within the new batch keys must be unique."""
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def upsert_batches(batches: DataFrame, keys: Sequence[str], batch: str = "batch") -> DataFrame:
    """Latest batch wins per key in a table that keeps its batches; of several rows of one
    key and batch the largest wins."""
    rest = [c for c in batches.columns if c not in keys]
    latest = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(batch), *rest)).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def replace_dates(existing: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """All rows of the dates (or other slice keys) present in the batch are replaced."""
    return existing.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def append_unseen(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose id is not stored yet; stored rows never change."""
    return existing.unionByName(fresh.join(existing.select(*keys), list(keys), "left_anti"))


def drop_older_than(df: DataFrame, as_of: str, days: int, column: str = "pull_date") -> DataFrame:
    return df.filter(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrite exactly the partitions present in ``df`` (dynamic partition overwrite).

    Rows are gathered by partition, and AQE splits the large ones over several tasks.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def archive(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        export_parquet(df, f"{folder}/{name}")


def vintage_manifest(df: DataFrame, vintage: str) -> DataFrame:
    """One row: number of rows and an order-free content hash of a snapshot."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("content_hash")
    ).withColumn("vintage", F.lit(vintage))


def snapshot_vintage(df: DataFrame, path: str, vintage: str) -> DataFrame:
    """Write an immutable vintage; a stored vintage is never overwritten."""
    target = f"{path}/vintage={vintage}"
    df.write.mode("errorifexists").parquet(target)
    return vintage_manifest(df.sparkSession.read.parquet(target), vintage)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """One row per key by an explicit order (first or last)."""
    o = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*o)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
