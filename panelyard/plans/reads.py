"""Read functions offered to users: parameterised DataFrames over the published tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import events_overlapping


def _between(start: str | None, end: str | None, column: str = "date") -> Column:
    c = F.lit(True)
    if start:
        c = c & (F.col(column) >= F.lit(start).cast("date"))
    if end:
        c = c & (F.col(column) <= F.lit(end).cast("date"))
    return c


def event_window(panel: DataFrame, entity, date: str, before: int, after: int, variables: Sequence[str]) -> DataFrame:
    """Per variable: rows, sums before, after and over the window around a date."""
    d0 = F.lit(date).cast("date")
    d = panel.filter((F.col("entity") == entity) & F.col("variable").isin(*variables) & F.col("date").between(F.date_sub(d0, before), F.date_add(d0, after)))
    return d.groupBy("variable").agg(
        F.count("value").alias("n_days"), F.sum(F.when(F.col("date") < d0, F.col("value"))).alias("pre_sum"),
        F.sum(F.when(F.col("date") >= d0, F.col("value"))).alias("post_sum"), F.sum("value").alias("window_sum"), F.max(F.when(F.col("date") == d0, F.col("value"))).alias("at_date"))


events_in_window = events_overlapping


def market_snapshot(daily: DataFrame, meta: DataFrame, outcomes: DataFrame, category: str | None = None, date: str | None = None) -> DataFrame:
    """Snapshot rows of one day (default the latest) with market and outcome attributes and the
    days to the market's end."""
    d = daily.filter(F.col("snapshot_date") == F.lit(date).cast("date")) if date else daily.join(daily.agg(F.max("snapshot_date").alias("snapshot_date")), "snapshot_date")
    j = d.join(meta, "market_id", "left").join(outcomes, ["market_id", "outcome_id"], "left")
    if category:
        j = j.filter(F.col("category") == category)
    return j.withColumn("days_to_end", F.datediff("end_date", "snapshot_date").cast("long"))


def entity_signal_now(signals: DataFrame, spill: DataFrame, entity, channels: Sequence[str] | None = None) -> DataFrame:
    """Live market effects on one entity: probability x elasticity x confidence weight."""
    from ..operators.markets import CONFIDENCE_WEIGHT

    w = F.create_map(*[x for k, v in CONFIDENCE_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    s = spill.filter(F.col("entity") == entity)
    if channels:
        s = s.filter(F.col("channel").isin(*channels))
    j = s.join(signals, "market_id").withColumn("effect", F.col("probability") * F.col("elasticity") * F.coalesce(w[F.col("confidence")], F.lit(0.75)))
    return j.select("market_id", "channel", "probability", "elasticity", "effect")


def markets_about(meta: DataFrame, snapshot: DataFrame, keyword: str, text: str = "question") -> DataFrame:
    return meta.filter(F.lower(text).contains(keyword.lower())).join(snapshot, "market_id", "left")


def commodity_series(panel: DataFrame, series: Sequence[str], feature: str, start: str | None = None, end: str | None = None) -> DataFrame:
    names = [f"{s.upper()}_{feature.upper()}" for s in series]
    return panel.filter(F.col("variable").isin(*names) & _between(start, end)).select("date", "variable", "value")


def daily_series(panel: DataFrame, entity, variables: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    return panel.filter((F.col("entity") == entity) & F.col("variable").isin(*variables) & _between(start, end)).select("date", "variable", "value")


def entity_returns(returns: DataFrame, start: str | None = None, end: str | None = None, latest_only: bool = False, rank: str = "desc", limit: int | None = None) -> DataFrame:
    """Returns in a range; ``latest_only`` keeps the last date, ranked best or worst first."""
    d = returns.filter(_between(start, end))
    if latest_only:
        d = d.join(d.agg(F.max("date").alias("date")), "date")
    o = F.col("ret").desc_nulls_last() if rank == "desc" else F.col("ret").asc_nulls_last()
    out = d.orderBy(o, "entity", "date")
    return out.limit(limit) if limit else out


def window_start(as_of: Column, window: str) -> Column:
    """First date of 'latest', 'ytd' or 'Nm' ending at as_of."""
    if window == "latest":
        return as_of
    if window == "ytd":
        return F.trunc(as_of, "year")
    if window.endswith("m") and window[:-1].isdigit():
        return F.add_months(as_of, -int(window[:-1]) + 1)
    raise ValueError(f"unknown window {window!r}")


def factor_returns(df: DataFrame, window: str, factors: Sequence[str] | None = None, rank: str = "desc", n: int | None = None) -> DataFrame:
    """Summed factor returns over a window ending at the last date, ranked."""
    d = df.filter(F.col("factor").isin(*factors)) if factors else df
    last = d.agg(F.max("date").alias("_last"))
    d = d.join(last).filter(F.col("date") >= window_start(F.col("_last"), window))
    s = d.groupBy("factor").agg(F.sum("value").alias("total"), F.count("value").alias("n_periods"))
    o = F.col("total").desc_nulls_last() if rank == "desc" else F.col("total").asc_nulls_last()
    out = s.orderBy(o, "factor")
    return out.limit(n) if n else out


def return_leaders(entity_returns_df: DataFrame, factor_returns_df: DataFrame, scope: str, window: str, direction: str, n: int) -> DataFrame:
    """Leaders or laggards among entities or factors over a window."""
    d = entity_returns_df.select("date", F.col("entity").alias("factor"), F.col("ret").alias("value")) if scope == "entity" else factor_returns_df
    return factor_returns(d, window, rank="desc" if direction == "leaders" else "asc", n=n).withColumnRenamed("factor", "name")


def prior_snapshot(rows: DataFrame, entity, min_confidence: float = 0.0) -> DataFrame:
    return rows.filter((F.col("entity") == entity) & (F.col("thresholds") == "pit") & (F.col("confidence") >= min_confidence)).orderBy(F.col("confidence").desc(), "factor", "horizon")


def factor_snapshot(state: DataFrame, variable: str) -> DataFrame:
    """Latest cross-section of one variable with its rank."""
    d = state.filter(F.col("variable") == variable)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("variable").orderBy(F.col("value").desc_nulls_last(), "entity")).cast("long"))


def region_factor_series(factors: DataFrame, region_of: DataFrame, entity, names: Sequence[str]) -> DataFrame:
    """An entity's regional factors in wide form."""
    r = region_of.filter(F.col("entity") == entity).select("region")
    return factors.join(r, "region").groupBy("date").pivot("factor", list(names)).agg(F.first("value"))


def register(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """User SQL over the registered views."""
    return spark.sql(sql)
