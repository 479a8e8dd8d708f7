"""Cross-sectional and time-series normalisation of tidy panels.

Cross-sectional statistics are grouped aggregates (combined map-side) joined back on the
group, not windows: one date may hold any number of entities.  Time-series statistics are
windows over one (entity, variable) series, whose length is bounded by the calendar.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import (
    SERIES, clip, guarded, last_rows, prior_rows, series, so_far, spread,
)
from ..functions.ranks import average_ranks, group_quantiles, positions

CROSS = ("date", "variable")

# Window and minimum number of observations by native frequency.
TS_WINDOW = {"daily": 252, "monthly": 60, "quarterly": 20, "annual": 10}
TS_MINIMUM = {"daily": 63, "monthly": 24, "quarterly": 8, "annual": 5}


def cross_z(
    df: DataFrame,
    by: Sequence[str] = CROSS,
    value: str = "value",
    ddof: int = 0,
    minimum: int = 2,
    on_zero: float | None = None,
    out: str = "z",
) -> DataFrame:
    """Z-score against the group.  A zero spread gives ``on_zero``; groups with fewer than
    ``minimum`` values give NULL."""
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("_m"), spread(value, ddof).alias("_s"), F.count(value).alias("_c")
    )
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    if on_zero is not None:
        z = F.when((F.col("_s") == 0) & F.col(value).isNotNull(), F.lit(float(on_zero))).otherwise(z)
    return (
        df.join(stats, list(by), "left")
        .withColumn(out, F.when(F.col("_c") >= minimum, z))
        .drop("_m", "_s", "_c")
    )


def peer_z(df: DataFrame, by: Sequence[str] = CROSS, value: str = "value", out: str = "z") -> DataFrame:
    """Z-score against the other members of the group (self excluded, population spread)."""
    stats = df.groupBy(*by).agg(
        F.sum(value).alias("_s1"),
        F.sum(F.col(value) * F.col(value)).alias("_s2"),
        F.count(value).alias("_c"),
    )
    x, peers = F.col(value), F.col("_c") - 1
    mean = (F.col("_s1") - x) / peers
    var = F.greatest(F.lit(0.0), (F.col("_s2") - x * x) / peers - mean * mean)
    return (
        df.join(stats, list(by), "left")
        .withColumn("_pm", F.when(F.col("_c") >= 2, mean))
        .withColumn("_ps", F.when(F.col("_c") >= 2, F.sqrt(var)))
        .withColumn(
            out,
            F.when(F.col("_ps") == 0, F.lit(0.0)).otherwise((x - F.col("_pm")) / F.col("_ps")),
        )
        .drop("_s1", "_s2", "_c", "_pm", "_ps")
    )


def percent_rank_average(
    df: DataFrame, by: Sequence[str] = CROSS, value: str = "value", out: str = "pct"
) -> DataFrame:
    """Tie-averaged rank divided by the number of values (in (0, 1])."""
    r = average_ranks(df, by, value, out="_r", total="_t")
    return r.withColumn(out, F.col("_r") / F.col("_t")).drop("_r", "_t")


def oriented_rank(
    df: DataFrame,
    by: Sequence[str] = ("date",),
    value: str = "value",
    tie: Sequence[str] = ("entity",),
    higher_is_better: bool = True,
    minimum: int = 5,
    out: str = "rank",
) -> DataFrame:
    """1 = best; groups with fewer than ``minimum`` values are dropped."""
    r = positions(df, by, value, tie, descending=higher_is_better, out=out, total="_n")
    return r.filter(F.col("_n") >= minimum).drop("_n")


def rolling_z(
    df: DataFrame,
    window: int,
    minimum: int,
    by: Sequence[str] = SERIES,
    value: str = "value",
    order: str = "date",
    ddof: int = 0,
    prior: bool = False,
    on_zero: float | None = None,
    out: str = "z",
) -> DataFrame:
    """Z-score against the trailing rows, with (default) or without the current row."""
    w = series(by, order)
    frame = prior_rows(w, window) if prior else last_rows(w, window)
    return _framed_z(df, frame, minimum, value, ddof, on_zero, out)


def expanding_z(
    df: DataFrame,
    minimum: int = 1,
    by: Sequence[str] = SERIES,
    value: str = "value",
    order: str = "date",
    ddof: int = 1,
    on_zero: float | None = 0.0,
    out: str = "z",
) -> DataFrame:
    """Z-score against all history up to and including the current row."""
    return _framed_z(df, so_far(series(by, order)), minimum, value, ddof, on_zero, out)


def expanding_z_from_zero(
    df: DataFrame, by: Sequence[str] = SERIES, value: str = "value", order: str = "date", out: str = "z"
) -> DataFrame:
    """Population expanding z whose first value, and every zero-spread value, is 0."""
    return expanding_z(df, 1, by, value, order, ddof=0, on_zero=0.0, out=out)


def _framed_z(df, frame, minimum, value, ddof, on_zero, out) -> DataFrame:
    m = guarded(F.avg(value).over(frame), value, frame, minimum)
    s = guarded(spread(value, ddof).over(frame), value, frame, minimum)
    d = df.withColumns({"_m": m, "_s": s})
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    if on_zero is not None:
        z = F.when((F.col("_s") == 0) & F.col(value).isNotNull(), F.lit(float(on_zero))).otherwise(z)
    return d.withColumn(out, z).drop("_m", "_s")


def surprise_scale(
    df: DataFrame,
    window: int,
    minimum: int,
    by: Sequence[str] = SERIES,
    value: str = "value",
    order: str = "date",
    out: str = "z",
) -> DataFrame:
    """x / standard deviation of the prior window; the mean is not removed."""
    frame = prior_rows(series(by, order), window)
    s = guarded(F.stddev_samp(value).over(frame), value, frame, minimum)
    return df.withColumn("_s", s).withColumn(
        out, F.when(F.col("_s") > 0, F.col(value) / F.col("_s"))
    ).drop("_s")


def signed_composite(
    df: DataFrame,
    signs: dict[str, float],
    name: str,
    keys: Sequence[str] = ("date", "entity"),
    value: str = "value",
) -> DataFrame:
    """Mean of the legs present on a date, each multiplied by its sign."""
    sign = F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(float(v)))])
    return (
        df.filter(F.col("variable").isin(*signs))
        .groupBy(*keys)
        .agg(F.avg(F.col(value) * sign[F.col("variable")]).alias(value), F.count(value).alias("legs"))
        .withColumn("variable", F.lit(name))
    )


def quantile_winsor(
    df: DataFrame,
    lo: float,
    hi: float,
    by: Sequence[str] = CROSS,
    value: str = "value",
    out: str = "value",
) -> DataFrame:
    """Clip each group to its own quantiles."""
    q = group_quantiles(df, by, value, {"_lo": lo, "_hi": hi})
    return df.join(q, list(by), "left").withColumn(out, clip(value, F.col("_lo"), F.col("_hi"))).drop(
        "_lo", "_hi"
    )


def normalised_panel(
    panel: DataFrame,
    frequency: dict[str, str] | None = None,
    skip_sources: Sequence[str] = (),
    origin: str = "generated",
) -> DataFrame:
    """The ``_CS`` and ``_TS`` variants of every raw variable in one tidy panel.

    ``frequency`` maps a source to its native frequency (default monthly), which fixes the
    rolling window.  Already normalised variables and ``skip_sources`` are left out.
    """
    raw = panel.filter(
        F.col("value").isNotNull()
        & ~F.col("variable").endswith("_CS")
        & ~F.col("variable").endswith("_TS")
    )
    if skip_sources:
        raw = raw.filter(~F.col("source").isin(*skip_sources))

    def tagged(d: DataFrame, kind: str, look: Column, least: Column) -> DataFrame:
        return d.filter(F.col("z").isNotNull()).select(
            "date",
            "entity",
            F.col("z").alias("value"),
            F.concat("variable", F.lit("_" + kind.upper())).alias("variable"),
            "source",
            F.lit(kind).alias("normalization"),
            F.col("variable").alias("base_variable"),
            F.lit(origin).alias("normalization_origin"),
            look.cast("int").alias("lookback_observations"),
            least.cast("int").alias("min_observations"),
        )

    cs = tagged(
        cross_z(raw, ("variable", "source", "date")), "cs", F.lit(None), F.lit(2)
    )
    freq = frequency or {}
    named: dict[str, list[str]] = {}
    for src, f in freq.items():
        named.setdefault(f, []).append(src)
    named.setdefault("monthly", [])
    out = cs
    others = [s for f, ss in named.items() if f != "monthly" for s in ss]
    for f, sources in named.items():
        if f not in TS_WINDOW:
            continue  # event-driven sources have no rolling window
        part = raw.filter(~F.col("source").isin(*others)) if f == "monthly" and others else (
            raw if f == "monthly" else raw.filter(F.col("source").isin(*sources))
        )
        z = rolling_z(part, TS_WINDOW[f], TS_MINIMUM[f], ("entity", "variable", "source"))
        out = out.unionByName(tagged(z, "ts", F.lit(TS_WINDOW[f]), F.lit(TS_MINIMUM[f])))
    return out
