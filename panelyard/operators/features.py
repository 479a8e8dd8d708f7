"""Time-series features of tidy panels: changes, fills, outliers, percentiles, runs, spreads.

All windows run over one series (``by``), at most one row per calendar date.  Where SQL
windows would be quadratic (expanding order statistics) or cannot state the recursion
(exponential smoothing), one series at a time goes through ``applyInPandas``.
"""
from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import (
    SERIES, before, clean, clip, compounded, guarded, last_rows, month_start, prior_rows, ratio, series, so_far,
)
from ..functions.ranks import group_quantiles, join_safe

MAD_SCALE = 1.4826


# --- changes, returns, levels -------------------------------------------------------------

def real_changes(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Keep the first observation of a series and every row that changes its value."""
    prev = F.lag(value).over(series(by))
    first = F.row_number().over(series(by)) == 1
    return (
        df.filter(F.col(value).isNotNull())
        .withColumns({"_p": prev, "_f": first})
        .filter(F.col("_f") | ~F.col(value).eqNullSafe(F.col("_p")))
        .drop("_p", "_f")
    )


def last_z(
    df: DataFrame, window: int, minimum: int, by: Sequence[str] = SERIES, value: str = "value"
) -> DataFrame:
    """z of each series' last value against its trailing window (sample spread)."""
    d = df.filter(F.col(value).isNotNull())
    back = Window.partitionBy(*by).orderBy(F.col("date").desc())
    d = d.withColumn("_r", F.row_number().over(back)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    recent = d.filter((F.col("_r") <= window) & (F.col("_n") >= minimum))
    s = F.stddev_samp(value)
    return (
        recent.groupBy(*by)
        .agg(
            F.max("date").alias("date"),
            F.max(F.when(F.col("_r") == 1, F.col(value))).alias("last_value"),
            F.avg(value).alias("_m"),
            s.alias("_s"),
            F.count("*").alias("n_window"),
        )
        .withColumn("z", F.when(F.col("_s") > 0, (F.col("last_value") - F.col("_m")) / F.col("_s")))
        .drop("_m", "_s")
    )


def trailing_return(
    returns: DataFrame, n: int, by: Sequence[str] = ("entity",), ret: str = "ret", out: str = "trailing"
) -> DataFrame:
    """Compounded return over the last n rows the entity really has (NULL before n rows)."""
    d = returns.filter(F.col(ret).isNotNull())
    frame = last_rows(series(by), n)
    return d.withColumn(out, guarded(compounded(ret, frame), ret, frame, n))


def on_calendar(df: DataFrame, limit: int, by: Sequence[str] = ("entity",), values: Sequence[str] = ("trailing",)) -> DataFrame:
    """Carry each row forward over at most ``limit`` following dates of the common calendar.

    Each observation is expanded to the dates it covers, so no entities x dates grid is built.
    """
    cal = df.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    pos = df.join(cal, "date")
    last = cal.groupBy().agg(F.max("_i").alias("_end"))
    nxt = F.lead("_i").over(Window.partitionBy(*by).orderBy("_i"))
    pos = pos.withColumn("_nx", nxt).join(last)
    stop = F.least(F.coalesce(F.col("_nx") - 1, F.col("_end")), F.col("_i") + limit)
    return (
        pos.withColumn("_i", F.explode(F.sequence(F.col("_i"), stop)))
        .select(*by, "_i", *values)
        .join(cal, "_i")
        .drop("_i")
    )


def shifted_return(
    df: DataFrame, n: int, forward: bool = False, by: Sequence[str] = SERIES, value: str = "value", out: str = "ret"
) -> DataFrame:
    """value[t+n]/value[t]-1 (forward) or value[t]/value[t-n]-1 (trailing)."""
    w = series(by)
    e = (
        ratio(F.lead(value, n).over(w), F.col(value)) - 1
        if forward
        else ratio(F.col(value), F.lag(value, n).over(w)) - 1
    )
    return df.withColumn(out, e)


def change(
    df: DataFrame, n: int, absolute: bool, by: Sequence[str] = SERIES, value: str = "value", out: str = "change"
) -> DataFrame:
    p = F.lag(value, n).over(series(by))
    return df.withColumn(out, F.col(value) - p if absolute else ratio(F.col(value), p) - 1)


def moving_average_ratio(
    df: DataFrame, n: int, by: Sequence[str] = SERIES, value: str = "value", out: str = "ma_ratio"
) -> DataFrame:
    f = last_rows(series(by), n)
    return df.withColumn(out, ratio(F.col(value), guarded(F.avg(value).over(f), value, f, n)))


def calendar_delta(
    df: DataFrame, months: int = 12, by: Sequence[str] = SERIES, value: str = "value", out: str = "delta"
) -> DataFrame:
    """Difference to the same month ``months`` earlier; missing months do not compress it."""
    past = df.select(*by, F.add_months("date", months).alias("date"), F.col(value).alias("_past"))
    return df.join(past, [*by, "date"], "left").withColumn(out, F.col(value) - F.col("_past")).drop("_past")


def forward_fill(
    df: DataFrame, limit: int | None, by: Sequence[str] = SERIES, value: str = "value", out: str = "value"
) -> DataFrame:
    """Fill NULLs from the last value at most ``limit`` rows back (None: any distance)."""
    w = series(by)
    frame = so_far(w) if limit is None else last_rows(w, limit + 1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(frame))


# Median gap in days up to which a panel counts as of that frequency, and how
# many months an observation is carried.
FREQUENCY_GAPS = (("monthly", 45), ("quarterly", 140), ("annual", 430))
FILL_MONTHS = {"monthly": 2, "quarterly": 4, "annual": 15, "sparse": 0}


def panel_frequency(df: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """Frequency of each variable from the median gap between its observed dates."""
    dates = df.filter(F.col("value").isNotNull()).select(*by, "date").distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*by).orderBy("date")))
    g = dates.withColumn("_g", gap).groupBy(*by).agg(
        F.count("*").alias("_n"), F.percentile("_g", F.lit(0.5)).alias("median_gap")
    )
    kind = F.when(F.col("_n") < 3, "sparse")
    for name, edge in FREQUENCY_GAPS:
        kind = kind.when(F.col("median_gap") <= edge, name)
    return g.withColumn("frequency", kind.otherwise("sparse")).drop("_n")


def expand_monthly(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Causal monthly panel: each observation covers its month and, up to the fill limit of
    its variable's frequency, the months before the next one.  Sparse variables pass through."""
    freq = panel_frequency(df).select("variable", "frequency")
    end = df.groupBy("variable").agg(F.max("date").alias("_end"))
    limit = F.create_map(*[x for k, v in FILL_MONTHS.items() for x in (F.lit(k), F.lit(v))])
    d = df.filter(F.col("value").isNotNull()).withColumn("_nx", F.lead("date").over(series(by)))
    d = d.join(freq, "variable").join(end, "variable").withColumn("_lim", limit[F.col("frequency")])
    stop = F.least(
        F.coalesce(F.add_months("_nx", -1), F.col("_end")), F.add_months("date", F.col("_lim")), F.col("_end")
    )
    months = F.when(F.col("_lim") > 0, F.sequence("date", F.greatest(stop, F.col("date")), F.expr("interval 1 month")))
    return d.withColumn("date", F.explode(F.coalesce(months, F.array("date")))).select(
        *by, "date", "value", "frequency"
    )


# --- outliers -----------------------------------------------------------------------------

def rolling_mad_winsor(
    df: DataFrame,
    window: int = 252,
    minimum: int = 60,
    k: float = 5.0,
    by: Sequence[str] = SERIES,
    value: str = "value",
    out: str = "value",
) -> DataFrame:
    """Clip to the trailing median +- k scaled MAD; warm-up and zero MAD pass through."""
    f = last_rows(series(by), window)

    def med(c: str) -> Column:
        return guarded(F.percentile(c, F.lit(0.5)).over(f), c, f, minimum)

    d = df.withColumn("_med", med(value))
    d = d.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    d = d.withColumn("_mad", med("_dev") * MAD_SCALE)
    bounded = clip(value, F.col("_med") - k * F.col("_mad"), F.col("_med") + k * F.col("_mad"))
    return d.withColumn(out, F.when(F.col("_mad") > 0, bounded).otherwise(F.col(value))).drop(
        "_med", "_dev", "_mad"
    )


def full_mad_winsor(
    df: DataFrame, k: float = 5.0, by: Sequence[str] = SERIES, value: str = "value", out: str = "value"
) -> DataFrame:
    """Clip to the whole-sample median +- k scaled MAD of each series."""
    by = list(by)
    med = group_quantiles(df, by, value, {"_med": 0.5})
    d = join_safe(df, med, by)
    mad = group_quantiles(
        d.withColumn("_dev", F.abs(F.col(value) - F.col("_med"))), by, "_dev", {"_mad": 0.5}
    )
    d = join_safe(d, mad, by)
    r = k * MAD_SCALE * F.col("_mad")
    return d.withColumn(out, clip(value, F.col("_med") - r, F.col("_med") + r)).drop("_med", "_mad")


def _per_series(df: DataFrame, by: Sequence[str], fn, extra: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """Apply fn to each date-ordered series; fn returns {column: array} to attach."""
    names = {n for n, _ in extra}
    fields = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in extra])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable").reset_index(drop=True)
        res = fn(pdf)
        return pdf.assign(**res)[[f.name for f in schema.fields]]

    return df.groupBy(*by).applyInPandas(run, schema)


def ewm_mean(
    df: DataFrame, columns: dict[str, tuple[str, int]], by: Sequence[str] = SERIES, minimum: int = 1
) -> DataFrame:
    """Recursive exponential means: {out: (value column, span)}; gaps keep decaying."""

    def fn(pdf: pd.DataFrame) -> dict:
        return {
            out: pdf[c].astype("float64").ewm(span=span, adjust=False, min_periods=minimum).mean().to_numpy()
            for out, (c, span) in columns.items()
        }

    return nan_to_null(_per_series(df, by, fn, [(o, T.DoubleType()) for o in columns]), columns)


def ewm_outlier_replace(
    df: DataFrame,
    span: int = 20,
    sigma: float = 4.0,
    minimum: int = 10,
    by: Sequence[str] = SERIES,
    value: str = "value",
    out: str = "value_clean",
) -> DataFrame:
    """Replace values more than sigma exponential deviations from the exponential mean."""

    def fn(pdf: pd.DataFrame) -> dict:
        x = pdf[value].astype("float64")
        e = x.ewm(span=span, adjust=False, min_periods=minimum)
        m, s = e.mean(), e.std()
        far = ((x - m) / s.where(s > 1e-12)).abs() > sigma
        return {out: x.mask(far, m).to_numpy()}

    return nan_to_null(_per_series(df, by, fn, [(out, T.DoubleType())]), [out])


def local_outlier_replace(
    df: DataFrame, window: int = 20, sigma: float = 4.0, by: Sequence[str] = SERIES, value: str = "value", out: str = "value_clean", minimum: int = 10
) -> DataFrame:
    """Replace values that lie more than ``sigma`` weighted deviations from the weighted mean
    of the up to ``window`` rows on either side, the row itself left out.

    A neighbour's weight decays with its distance from the latest neighbour by the factor
    (span - 1) / (span + 1) with span ``window``; missing neighbours take a place but no
    weight; the variance is the unbiased one for such weights.  Rows with fewer than
    ``minimum`` neighbours stay.  The frame holds 2 * window + 1 rows, and both moments are
    folds over it.
    """
    w = series(by)
    decay = (window - 1.0) / (window + 1.0)
    d = df.withColumn("_x", clean(value)).withColumn("_at", F.row_number().over(w))
    d = d.withColumn("_frame", F.collect_list(F.struct("_at", "_x")).over(w.rowsBetween(-window, window)))
    d = d.withColumn("_near", F.filter("_frame", lambda p: p["_at"] != F.col("_at")))
    terms = F.transform("_near", lambda p, i: F.struct(p["_x"].alias("x"), F.pow(F.lit(decay), F.size("_near") - 1 - i).alias("w")))
    d = d.withColumn("_near", F.filter(terms, lambda p: p["x"].isNotNull())).withColumn("_size", F.size("_frame") - 1)

    def total(f) -> Column:
        return F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + f(p))

    d = d.withColumn("_w1", total(lambda p: p["w"])).withColumn("_w2", total(lambda p: p["w"] * p["w"]))
    d = d.withColumn("_m", F.when(F.col("_w1") > 0, total(lambda p: p["w"] * p["x"]) / F.col("_w1")))
    free = F.col("_w1") - F.col("_w2") / F.col("_w1")
    square = total(lambda p: p["w"] * (p["x"] - F.col("_m")) * (p["x"] - F.col("_m")))
    d = d.withColumn("_s", F.when(F.size("_near") > 1, F.sqrt(square / free)))
    far = (F.col("_size") >= minimum) & (F.col("_s") > sys.float_info.epsilon) & (F.abs(F.col("_x") - F.col("_m")) > sigma * F.col("_s"))
    new = F.when(far, F.col("_m")).otherwise(F.col("_x"))
    return d.withColumn(out, new).drop("_x", "_at", "_frame", "_near", "_size", "_w1", "_w2", "_m", "_s")


def nan_to_null(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def sheet_cleaned(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value", trailing: bool = True) -> DataFrame:
    """Level cleaning chain: unbounded fill, MAD winsor, local outlier replacement."""
    d = forward_fill(df, None, by, value, value)
    if trailing:
        return ewm_outlier_replace(rolling_mad_winsor(d, by=by, value=value, out=value), by=by, value=value)
    return local_outlier_replace(full_mad_winsor(d, by=by, value=value, out=value), by=by, value=value)


# --- percentiles and buckets --------------------------------------------------------------

def rolling_percentile(
    df: DataFrame, window: int = 120, minimum: int = 36, by: Sequence[str] = SERIES, value: str = "value", out: str = "pct"
) -> DataFrame:
    """Percent of the trailing window at or below the current value."""
    f = last_rows(series(by), window)
    seen = F.collect_list(value).over(f)
    d = df.withColumn("_h", seen)
    share = F.size(F.filter("_h", lambda v: v <= F.col(value))) / F.size("_h") * 100
    return d.withColumn(out, F.when((F.size("_h") >= minimum) & F.col(value).isNotNull(), share)).drop("_h")


def expanding_percentile(
    df: DataFrame,
    minimum: int = 24,
    inclusive: bool = False,
    by: Sequence[str] = SERIES,
    value: str = "value",
    out: str = "pct",
) -> DataFrame:
    """Share of history at or below the value.

    Prior-only by default (NULL before ``minimum`` earlier values); ``inclusive`` counts the
    current value and splits ties (mean of strict and weak shares).
    """

    def fn(pdf: pd.DataFrame) -> dict:
        hist: list[float] = []
        res = np.full(len(pdf), np.nan)
        for i, x in enumerate(pdf[value].to_numpy(dtype="float64")):
            ok = np.isfinite(x)
            if inclusive:
                if ok:
                    insort(hist, x)
                if ok and len(hist) >= minimum:
                    res[i] = (bisect_left(hist, x) + bisect_right(hist, x)) / 2 / len(hist)
            else:
                if ok and len(hist) >= minimum:
                    res[i] = bisect_right(hist, x) / len(hist)
                if ok:
                    insort(hist, x)
        return {out: res}

    return nan_to_null(_per_series(df, by, fn, [(out, T.DoubleType())]), [out])


def pit_buckets(
    df: DataFrame, k: int = 10, minimum: int = 36, by: Sequence[str] = SERIES, value: str = "value", out: str = "bucket"
) -> DataFrame:
    """Point-in-time k-quantile bucket: thresholds from history including the current value,
    linearly interpolated; NULL during warm-up."""

    def fn(pdf: pd.DataFrame) -> dict:
        hist: list[float] = []
        res: list = [None] * len(pdf)
        for i, x in enumerate(pdf[value].to_numpy(dtype="float64")):
            if not np.isfinite(x):
                continue
            insort(hist, x)
            n = len(hist)
            if n < max(minimum, 2):
                continue
            b = 1
            for j in range(1, k):
                at = (n - 1) * j / k
                lo = int(at)
                w = at - lo
                cut = hist[lo] if w == 0 else hist[lo] + (hist[lo + 1] - hist[lo]) * w
                if x <= cut:
                    break
                b += 1
            res[i] = b
        return {out: pd.array(res, dtype="Int64")}

    return _per_series(df, by, fn, [(out, T.LongType())])


def full_sample_buckets(
    df: DataFrame, k: int = 10, by: Sequence[str] = SERIES, value: str = "value", out: str = "bucket"
) -> DataFrame:
    """Bucket against the whole-sample quantiles of the group (descriptive, not PIT)."""
    names = [f"_q{i}" for i in range(1, k)]
    cuts = group_quantiles(df, by, value, {n: i / k for i, n in enumerate(names, 1)})
    above = sum((F.col(value) > F.col(n)).cast("long") for n in names)
    return df.join(cuts, list(by), "left").withColumn(out, above + 1).drop(*names)


def value_cut_groups(
    df: DataFrame, k: int, by: Sequence[str] = ("date",), value: str = "value", out: str = "tile"
) -> DataFrame:
    """Cross-sectional quantile groups by value cuts (equal values share a group)."""
    return full_sample_buckets(df, k, by, value, out)


# --- runs, edges, drawdowns ---------------------------------------------------------------

def runs(df: DataFrame, state: str = "state", by: Sequence[str] = ("entity",)) -> DataFrame:
    """Maximal runs of equal state: start, end and length."""
    w = series(by)
    flag = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    d = df.withColumn("_c", flag).withColumn("_run", F.sum("_c").over(so_far(w)))
    return d.groupBy(*by, "_run", state).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length")
    ).drop("_run")


def transitions(df: DataFrame, state: str = "state", by: Sequence[str] = ("entity",)) -> DataFrame:
    """Counts and probabilities of moving from one state to the next row's state."""
    d = df.withColumn("next_state", F.lead(state).over(series(by))).filter(F.col("next_state").isNotNull())
    c = d.groupBy(F.col(state).alias("from_state"), "next_state").agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def persistence(df: DataFrame, horizons: Sequence[int] = (1, 3, 6), state: str = "state", by: Sequence[str] = ("entity",)) -> DataFrame:
    """Share of rows in the same state h rows later, and the mean run length."""
    w = series(by)
    same = {
        f"_s{h}": F.when(
            F.lead(state, h).over(w).isNotNull(), (F.lead(state, h).over(w) == F.col(state)).cast("double")
        )
        for h in horizons
    }
    p = df.withColumns(same).groupBy(*by).agg(*[F.avg(f"_s{h}").alias(f"persist_{h}") for h in horizons])
    return p.join(runs(df, state, by).groupBy(*by).agg(F.avg("length").alias("mean_duration")), list(by))


def rising_edges(df: DataFrame, event: str, clean_rows: int = 60, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Rows where the event holds after at least ``clean_rows`` rows without it."""
    w = series(by)
    d = df.withColumn("_i", F.row_number().over(w))
    last = F.max(F.when(F.col(event), F.col("_i"))).over(before(w))
    return d.withColumn("_q", F.col("_i") - 1 - F.coalesce(last, F.lit(0))).filter(
        F.col(event) & (F.col("_q") >= clean_rows)
    ).drop("_i", "_q")


def drawdown(
    returns: DataFrame, window: int | None = 252, by: Sequence[str] = ("entity",), ret: str = "ret", out: str = "drawdown"
) -> DataFrame:
    """Level over its running (or since-inception) maximum, minus one."""
    w = series(by)
    d = returns.withColumn("_lvl", F.exp(F.sum(F.log1p(ret)).over(so_far(w))))
    peak = F.max("_lvl").over(so_far(w) if window is None else last_rows(w, window))
    return d.withColumn(out, F.col("_lvl") / peak - 1).drop("_lvl")


# --- multi-series features ----------------------------------------------------------------

def rolling_abs_correlation(
    df: DataFrame, base: str, others: Sequence[str], window: int = 6, name: str = "variable", value: str = "value"
) -> DataFrame:
    """Mean absolute rolling correlation of one series with a few named others."""
    b = df.filter(F.col(name) == base).select("date", F.col(value).alias("_b"))
    d = df.filter(F.col(name).isin(*others)).join(b, "date")
    f = last_rows(Window.partitionBy(name).orderBy("date"), window)
    c = d.withColumn("_c", guarded(F.abs(F.corr("_b", value).over(f)), value, f, window))
    return c.groupBy("date").agg(F.avg("_c").alias("stress"), F.count("_c").alias("n_pairs"))


def two_leg_spread(
    df: DataFrame,
    first: str,
    second: str,
    name: str,
    kind: str = "difference",
    keys: Sequence[str] = ("date", "entity"),
    value: str = "value",
) -> DataFrame:
    """first - second, first / second, or the curve (first/second - 1) x 100 of positive legs."""
    legs = (
        df.filter(F.col("variable").isin(first, second))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("variable") == first, F.col(value))).alias("_a"),
            F.max(F.when(F.col("variable") == second, F.col(value))).alias("_b"),
        )
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )
    a, b = F.col("_a"), F.col("_b")
    if kind == "curve":
        legs = legs.filter((a > 0) & (b > 0))
    e = {"difference": a - b, "ratio": ratio(a, b), "curve": (a / b - 1) * 100}[kind]
    return legs.select(*keys, e.alias(value), F.lit(name).alias("variable"))


def flow_signals(
    df: DataFrame, split_guard: float = 0.2, window: int = 21, minimum: int = 15, z_window: int = 252, z_minimum: int = 120
) -> DataFrame:
    """Flows from (date, entity, shares, nav, aum): share change x nav with split days nulled,
    their rolling sum, its share of assets and its z-score."""
    w = series(["entity"])
    prev = F.lag("shares").over(w)
    chg = F.col("shares") - prev
    d = df.withColumn(
        "flow", F.when(~(F.abs(chg) / prev > split_guard), chg * F.col("nav"))
    )
    f = last_rows(w, window)
    d = d.withColumn("flow_sum", guarded(F.sum("flow").over(f), "flow", f, minimum))
    d = d.withColumn("flow_pct_aum", ratio("flow_sum", "aum") * 100)
    zf = last_rows(w, z_window)
    m, s = F.avg("flow_sum").over(zf), F.stddev_samp("flow_sum").over(zf)
    d = d.withColumns({"_m": m, "_s": s, "_c": F.count("flow_sum").over(zf)})
    ok = (F.col("_c") >= z_minimum) & (F.col("_s") > 0)
    return d.withColumn("flow_z", F.when(ok, (F.col("flow_sum") - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_c")


def vintage_revisions(df: DataFrame, by: Sequence[str] = ("entity", "variable", "target_year")) -> DataFrame:
    """Revision of each forecast against the vintage before it."""
    w = Window.partitionBy(*by).orderBy("vintage")
    return df.withColumns(
        {"prior_value": F.lag("value").over(w), "prior_vintage": F.lag("vintage").over(w)}
    ).withColumn("revision", F.col("value") - F.col("prior_value"))


def month_end_levels(df: DataFrame, by: Sequence[str], value: str = "value", only_changes: bool = False) -> DataFrame:
    """Last value of each month; with ``only_changes`` carried-forward rows are left out."""
    d = real_changes(df, by, value) if only_changes else df.filter(F.col(value).isNotNull())
    return d.groupBy(*by, month_start("date").alias("month")).agg(
        F.max_by(value, "date").alias(value), F.max("date").alias("date")
    )


def consensus_revisions(df: DataFrame, by: Sequence[str] = ("entity", "variable", "target_year")) -> DataFrame:
    """Month-end consensus with 1- and 3-row changes; series of one month are dropped."""
    me = month_end_levels(df, by).withColumnRenamed("value", "consensus")
    w = Window.partitionBy(*by).orderBy("month")
    return (
        me.withColumns(
            {
                "rev_1m": F.col("consensus") - F.lag("consensus", 1).over(w),
                "rev_3m": F.col("consensus") - F.lag("consensus", 3).over(w),
                "_n": F.count("*").over(Window.partitionBy(*by)),
            }
        )
        .filter(F.col("_n") >= 2)
        .drop("_n", "date")
    )


def fixed_horizon_blend(rev: DataFrame) -> DataFrame:
    """12-month-ahead revision: weight (12-m)/12 on this year's target, the rest on next year's."""
    r = rev.filter(F.col("rev_3m").isNotNull())
    keys = ["month", "entity", "variable"]
    cur = r.filter(F.col("target_year") == F.year("month")).select(*keys, F.col("rev_3m").alias("_c"))
    nxt = r.filter(F.col("target_year") == F.year("month") + 1).select(*keys, F.col("rev_3m").alias("_n"))
    w = (12 - F.month("month")) / 12
    return cur.join(nxt, keys).select(*keys, (w * F.col("_c") + (1 - w) * F.col("_n")).alias("value"))


def level_change_events(df: DataFrame, by: Sequence[str] = ("entity", "agency"), score: str = "score") -> DataFrame:
    """Rows where a score differs from the one before it, with the step."""
    d = df.withColumn("prior_score", F.lag(score).over(series(by)))
    return d.withColumn("delta", F.col(score) - F.col("prior_score")).filter(F.col("delta") != 0)


def commodity_features(df: DataFrame, by: Sequence[str] = ("entity",), value: str = "value") -> DataFrame:
    """Level, 1/3/12-row percent changes, 12-row volatility and 36-row z, unpivoted."""
    w = series(by)

    def pct(n: int) -> Column:
        return (ratio(F.col(value), F.lag(value, n).over(w)) - 1) * 100

    d = df.withColumns(
        {"mom_pct": pct(1), "yoy_pct": pct(12), "ret_3m_pct": pct(3), "ret_12m_pct": pct(12)}
    )
    f12, f36 = last_rows(w, 12), last_rows(w, 36)
    sd36 = F.stddev_pop(value).over(f36)
    d = d.withColumns(
        {
            "level": F.col(value),
            "vol_12m": guarded(F.stddev_pop("mom_pct").over(f12), "mom_pct", f12, 6),
            "_c": F.count(value).over(f36),
            "_m": F.avg(value).over(f36),
            "_s": sd36,
        }
    ).withColumn("z_36m", F.when((F.col("_c") >= 12) & (F.col("_s") > 0), (F.col(value) - F.col("_m")) / F.col("_s")))
    feats = ["level", "mom_pct", "yoy_pct", "ret_3m_pct", "ret_12m_pct", "vol_12m", "z_36m"]
    return (
        d.select(*by, "date", *feats)
        .unpivot([*by, "date"], feats, "feature", "value")
        .filter(F.col("value").isNotNull())
    )


def price_to_peak(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value", window: int = 13) -> DataFrame:
    """value / 12-row maximum x R-squared of the 13-row trend x its sign; full windows only."""
    w = series(by)
    f = last_rows(w, window)
    d = df.withColumn("_x", F.row_number().over(w).cast("double"))
    d = d.withColumns(
        {
            "_peak": F.max(value).over(last_rows(w, window - 1)),
            "_r2": F.regr_r2(F.col(value), F.col("_x")).over(f),
            "_b": F.regr_slope(F.col(value), F.col("_x")).over(f),
            "_n": F.count(value).over(f),
        }
    )
    score = F.col(value) / F.col("_peak") * F.col("_r2") * F.when(F.col("_b") > 0, 1).otherwise(-1)
    return d.withColumn("score", F.when(F.col("_n") == window, score)).drop("_x", "_peak", "_r2", "_b", "_n")


def default_probability(spread_bp: Column, tenor: float = 5.0, recovery: float = 0.40) -> Column:
    return 1 - F.exp(-spread_bp / 10000 * tenor / (1 - recovery))


def macro_state(df: DataFrame, value: str = "value", by: Sequence[str] = ("entity",)) -> DataFrame:
    """12-row percent change, recession rule (3-row mean over its 12-row low) and annualised
    3-row volatility of percent changes."""
    w = series(by)
    f3, f12 = last_rows(w, 3), last_rows(w, 12)
    d = df.withColumns(
        {
            "yoy": (ratio(F.col(value), F.lag(value, 12).over(w)) - 1) * 100,
            "_r": ratio(F.col(value), F.lag(value, 1).over(w)) - 1,
            "_u3": guarded(F.avg(value).over(f3), value, f3, 3),
        }
    )
    return d.withColumns(
        {
            "gap_from_low": F.col("_u3") - guarded(F.min("_u3").over(f12), "_u3", f12, 12),
            "vol_3m": guarded(F.stddev_samp("_r").over(f3), "_r", f3, 3) * (12**0.5) * 100,
        }
    ).withColumn("triggered", (F.col("gap_from_low") >= 0.5).cast("double")).drop("_r", "_u3")


def interval_membership(spine: DataFrame, intervals: DataFrame, default: float = 0.0) -> DataFrame:
    """Value of the interval a (entity, date) falls into, highest value first, else default.

    The equi key is the entity; an entity has a handful of intervals.
    """
    i = intervals.select(F.col("entity"), "start", "end", F.col("value").alias("_v"))
    hit = spine.join(i, "entity").filter((F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))
    best = hit.groupBy("entity", "date").agg(F.max("_v").alias("_v"))
    return spine.join(best, ["entity", "date"], "left").withColumn(
        "value", F.coalesce("_v", F.lit(float(default)))
    ).drop("_v")


def three_leg_premium(df: DataFrame, yield_leg: str, nominal: str, inflation: str, name: str, limit: int = 3) -> DataFrame:
    """yield - (nominal - inflation) on the union of the months of the legs, each leg filled
    at most ``limit`` months; all three legs must be present."""
    legs = df.filter(F.col("variable").isin(yield_leg, nominal, inflation))
    months = legs.select("date").distinct()
    span = F.sequence(F.lit(0), F.lit(limit))
    # A value covers its own month and the following ones of the shared calendar.
    cal = months.withColumn("_i", F.row_number().over(Window.orderBy("date")))
    d = legs.join(cal, "date")
    d = d.withColumn("_nx", F.lead("_i").over(Window.partitionBy(*SERIES).orderBy("_i")))
    d = d.withColumn("_i", F.explode(F.transform(span, lambda k: F.col("_i") + k))).filter(
        F.col("_nx").isNull() | (F.col("_i") < F.col("_nx"))
    )
    wide = d.groupBy("entity", "_i").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(a) for v, a in ((yield_leg, "_a"), (nominal, "_b"), (inflation, "_c"))]
    )
    return (
        wide.join(cal, "_i")
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_c").isNotNull())
        .select("date", "entity", (F.col("_a") - (F.col("_b") - F.col("_c"))).alias("value"), F.lit(name).alias("variable"))
    )


# Average daily traded value from which an instrument counts as liquid.
LIQUIDITY = (("high", 50_000_000), ("medium", 10_000_000), ("low", 1_000_000))


def liquidity_tier(adv: Column) -> Column:
    tier = F.when(adv.isNull(), "missing")
    for name, floor in LIQUIDITY:
        tier = tier.when(adv >= floor, name)
    return tier.otherwise("micro")


def price_state(returns: DataFrame, prices: DataFrame, as_of: str | None = None) -> DataFrame:
    """Latest 5/21/63-row returns of an entity and of its instrument, traded value, basis.

    ``prices``: (date, entity, close, volume), one instrument per entity.
    """
    r, p = returns, prices
    if as_of:
        r, p = r.filter(F.col("date") <= F.lit(as_of).cast("date")), p.filter(F.col("date") <= F.lit(as_of).cast("date"))
    w = series(["entity"])
    rr = r.withColumns(
        {f"ret_{n}": guarded(compounded("ret", last_rows(w, n)), "ret", last_rows(w, n), n) for n in (5, 21, 63)}
    )
    state = rr.groupBy("entity").agg(
        F.max("date").alias("return_date"), *[F.max_by(f"ret_{n}", "date").alias(f"ret_{n}") for n in (5, 21, 63)]
    )
    z = last_z(rr.select("entity", "date", F.col("ret_21").alias("value")), 756, 252, ("entity",)).select(
        "entity", F.col("z").alias("ret_21_z")
    )
    pp = p.withColumns(
        {
            **{f"px_{n}": ratio(F.col("close"), F.lag("close", n).over(w)) - 1 for n in (1, 5, 21, 63)},
            "adv_21": F.avg(F.col("close") * F.col("volume")).over(last_rows(w, 21)),
        }
    )
    inst = pp.groupBy("entity").agg(
        F.max("date").alias("price_date"),
        *[F.max_by(c, "date").alias(c) for c in ("px_5", "px_21", "px_63", "adv_21")],
    )
    both = pp.filter(F.col("px_1").isNotNull()).select("entity", "date", "px_1").join(
        r.select("entity", "date", "ret"), ["entity", "date"]
    )
    f21 = last_rows(w, 21)
    gap = both.withColumn("_g", F.col("px_1") - F.col("ret"))
    gap = gap.withColumn("value", guarded(F.sum("_g").over(f21), "_g", f21, 21))
    gz = last_z(gap.select("entity", "date", "value"), 756, 61, ("entity",)).select(
        "entity", F.col("z").alias("basis_z")
    )
    return (
        state.join(z, "entity", "left")
        .join(inst, "entity", "left")
        .join(gz, "entity", "left")
        .withColumns(
            {
                "basis_5": F.col("px_5") - F.col("ret_5"),
                "basis_21": F.col("px_21") - F.col("ret_21"),
                "liquidity": liquidity_tier(F.col("adv_21")),
            }
        )
    )
