"""Grouped aggregates over panels, edges and portfolios."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import before, last_rows, month_number, month_start, ratio, series, so_far
from ..functions.ranks import average_ranks, group_quantiles


def coverage(df: DataFrame, by: Sequence[str] = ("variable", "source"), exact: bool = True) -> DataFrame:
    """Rows, entities, dates and date range per variable and source.

    ``exact=False`` uses sketches for the distinct counts (one pass, no distinct shuffle).
    """
    n = F.countDistinct if exact else F.approx_count_distinct
    return df.groupBy(*by).agg(
        F.count("value").alias("n_obs"),
        n("entity").alias("n_entities"),
        n("date").alias("n_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def missingness(cov: DataFrame, forecast_prefixes: Sequence[str] = ()) -> DataFrame:
    """1 - observations / (months in window x entities), and a vintage-safe flag."""
    months = month_number("last_date") - month_number("first_date") + 1
    expected = months * F.greatest(F.col("n_entities"), F.lit(1))
    forecast = F.lit(False)
    for p in forecast_prefixes:
        forecast = forecast | F.col("variable").startswith(p)
    return cov.withColumns(
        {
            "missingness": F.greatest(F.lit(0.0), 1 - F.col("n_obs") / expected),
            "is_forecast": forecast,
        }
    ).withColumn("vintage_safe", ~F.col("is_forecast"))


def last_in_month(df: DataFrame, by: Sequence[str] = ("entity", "variable")) -> DataFrame:
    return df.filter(F.col("value").isNotNull()).groupBy(*by, month_start("date").alias("month")).agg(
        F.max_by("value", "date").alias("value")
    )


def factor_statistics(
    df: DataFrame, by: Sequence[str] = ("factor", "source"), short: int = 12, long: int = 60, minimum: int = 24, periods: int = 12
) -> DataFrame:
    """Latest value, sum of the last ``short`` (NULL if fewer), mean, spread and Sharpe of the
    last ``long`` per factor."""
    back = Window.partitionBy(*by).orderBy(F.col("date").desc())
    d = df.filter(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= max(short, long))
    v = F.col("value")
    in_s, in_l = F.when(F.col("_r") <= short, v), F.when(F.col("_r") <= long, v)
    s = d.groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 1, v)).alias("latest"),
        F.max(F.when(F.col("_r") == 1, F.col("date"))).alias("last_date"),
        F.when(F.count(in_s) >= short, F.sum(in_s)).alias("sum_short"),
        F.avg(in_l).alias("mean_long"),
        F.stddev_samp(in_l).alias("std_long"),
        F.count(in_l).alias("n_long"),
    )
    ok = (F.col("n_long") >= minimum) & (F.col("std_long") > 0)
    return s.withColumn("sharpe", F.when(ok, F.col("mean_long") * periods / (F.col("std_long") * periods**0.5)))


def running_sum_range(df: DataFrame, n: int = 252, by: Sequence[str] = ("factor", "source")) -> DataFrame:
    """Range of the running sum over each factor's last n rows."""
    back = Window.partitionBy(*by).orderBy(F.col("date").desc())
    d = df.filter(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= n)
    d = d.withColumn("_c", F.sum("value").over(so_far(series(by))))
    return d.groupBy(*by).agg((F.max("_c") - F.min("_c")).alias("drawdown_range"))


def mean_pair_correlation(
    df: DataFrame, window: int = 63, name: str = "factor", value: str = "value", series_per_task: int = 4_096
) -> DataFrame:
    """Mean off-diagonal correlation of all series over the last ``window`` dates before each
    date, without forming pairs.

    With every series standardised inside the window, the pair sum follows from the variance
    of the sum of the z's: mean corr = (sum_t (sum_i z_it)^2/(w-1) - N) / (N(N-1)).  Series
    without a full window (NaN counts as missing), or without spread in it, are left out of
    that date.

    A task holds ``series_per_task`` series over a stretch of dates, and what leaves it is one
    row of ``window`` sums per date, whatever the number of series.  A row is sent to its own
    stretch and, if the windows of the next one reach back to it, to that one too.
    """
    stretch = 4 * window
    dates = df.select("date").distinct().withColumn("_t", F.row_number().over(Window.orderBy("date")) - 1)
    d = df.filter(F.col(value).isNotNull()).join(dates, "date").select(F.col(name).alias("_name"), "_t", F.col(value).cast("double").alias("_x"))
    tasks = d.agg(F.greatest(F.lit(1), F.ceil(F.countDistinct("_name") / series_per_task)).alias("_k"))
    own, next_ = F.floor(F.col("_t") / stretch), F.floor((F.col("_t") + window - 1) / stretch)
    cut = d.join(tasks).withColumns({"_b": F.pmod(F.xxhash64("_name"), "_k"), "_c": F.explode(F.sequence(own, next_))})

    def sums(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * stretch - (window - 1)
        at, names = pd.factorize(p["_name"])
        x = np.full((stretch + window - 1, len(names)), np.nan)
        x[p["_t"].to_numpy() - first, at] = p["_x"].to_numpy()
        out = []
        for i in range(stretch):
            v = x[i:i + window]
            v = v[:, np.isfinite(v).all(axis=0) & (v.max(axis=0) > v.min(axis=0))]
            if v.shape[1]:
                z = (v - v.mean(axis=0)) / v.std(axis=0, ddof=1)
                out.append((first + i + window - 1, v.shape[1], z.sum(axis=1)))
        return pd.DataFrame(out, columns=["_end", "_n", "_s"])

    parts = cut.select("_c", "_b", "_name", "_t", "_x").groupBy("_c", "_b").applyInPandas(sums, "_end int, _n long, _s array<double>")
    # the sums of the tasks add up place by place
    per_t = parts.select("_end", "_n", F.posexplode("_s").alias("_at", "_z")).groupBy("_end", "_at").agg(F.sum("_z").alias("_s"), F.sum("_n").alias("_n"))
    k, q = F.max("_n"), F.sum(F.col("_s") * F.col("_s"))
    out = per_t.groupBy("_end").agg(k.alias("n_series"), ((q / (window - 1) - k) / (k * (k - 1))).alias("mean_corr"))
    ends = dates.select((F.col("_t") - 1).alias("_end"), "date")
    return out.filter("n_series > 1").join(ends, "_end").select("date", "n_series", "mean_corr")


def dispersion(df: DataFrame, by: Sequence[str] = ("date", "variable"), value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_samp(value).alias("dispersion"), F.count(value).alias("n"))


def benchmarks(returns: DataFrame, weights: DataFrame, single: str, ret: str = "ret") -> DataFrame:
    """Equal-weight, cap-weight and single-market benchmark return per date."""
    d = returns.join(weights.select("date", "entity", "weight"), ["date", "entity"], "left")
    return d.groupBy("date").agg(
        F.avg(ret).alias("equal_weight"),
        F.sum(F.col(ret) * F.col("weight")).alias("cap_weight"),
        F.max(F.when(F.col("entity") == single, F.col(ret))).alias("single_market"),
    )


def portfolio_shares(df: DataFrame) -> DataFrame:
    """Holdings (date, src, dst, amount) -> share of the reporter's portfolio, and share of the
    holding's inbound total where more than one reporter holds it."""
    out = df.groupBy("date", "src").agg(F.sum("amount").alias("_o"))
    inn = df.groupBy("date", "dst").agg(F.sum("amount").alias("_i"), F.countDistinct("src").alias("_n"))
    return (
        df.join(out, ["date", "src"]).join(inn, ["date", "dst"])
        .withColumns(
            {
                "share_of_reporter": F.when(F.col("_o") > 0, F.col("amount") / F.col("_o") * 100),
                "share_of_inbound": F.when((F.col("_i") > 0) & (F.col("_n") > 1), F.col("amount") / F.col("_i") * 100),
            }
        )
        .drop("_o", "_i", "_n")
    )


def trade_category_shares(df: DataFrame, category: Column, by: Sequence[str] = ("entity", "year")) -> DataFrame:
    """(…, exports, imports) per item -> category shares of the totals and their difference."""
    c = df.withColumn("category", category).groupBy(*by, "category").agg(
        F.sum("exports").alias("_x"), F.sum("imports").alias("_m")
    )
    tot = c.groupBy(*by).agg(F.sum("_x").alias("_tx"), F.sum("_m").alias("_tm"))
    return (
        c.filter(F.col("category").isNotNull())
        .join(tot, list(by))
        .select(
            *by, "category", ratio("_x", "_tx").alias("export_share"), ratio("_m", "_tm").alias("import_share"),
            (ratio("_x", "_tx") - ratio("_m", "_tm")).alias("net_share"),
        )
    )


def index_weights(caps: DataFrame, value: str = "value") -> DataFrame:
    """Percent of each date's total and its change against the entity's previous row."""
    tot = caps.groupBy("date").agg(F.sum(value).alias("_t")).filter(F.col("_t") > 0)
    d = caps.join(tot, "date").withColumn("weight_pct", F.col(value) / F.col("_t") * 100)
    return d.withColumn("weight_change", F.col("weight_pct") - F.lag("weight_pct").over(series(["entity"]))).drop("_t")


def percentile_composite(
    df: DataFrame, name: str, minimum: int = 2, negate: Sequence[str] = ()
) -> DataFrame:
    """Tie-averaged percentile (x 100) of each component per date, averaged over the
    components present (at least ``minimum``)."""
    d = df.filter(F.col("value").isNotNull()).withColumn(
        "value", F.when(F.col("variable").isin(*negate), -F.col("value")).otherwise(F.col("value")) if negate else F.col("value")
    )
    r = average_ranks(d, ["date", "variable"], "value").withColumn("_p", F.col("rank") / F.col("group_n") * 100)
    return (
        r.groupBy("date", "entity")
        .agg(F.avg("_p").alias("value"), F.count("_p").alias("components"))
        .filter(F.col("components") >= minimum)
        .withColumn("variable", F.lit(name))
    )


def demographic_index(df: DataFrame, beta: Column) -> DataFrame:
    """(entity, year, cohort, population) -> share-weighted index, its relative form (against
    the yearly mean share of each cohort) and 5- and 10-row changes of the latter."""
    p = df.groupBy("entity", "year", "cohort").agg(F.sum("population").alias("population"))
    tot = p.groupBy("entity", "year").agg(F.sum("population").alias("_t"))
    s = p.join(tot, ["entity", "year"]).withColumn("_s", F.col("population") / F.col("_t"))
    mean = s.groupBy("year", "cohort").agg(F.avg("_s").alias("_m"))
    d = s.join(mean, ["year", "cohort"]).groupBy("entity", "year").agg(
        (F.sum(F.col("_s") * beta) * 100).alias("index_abs"),
        (F.sum((F.col("_s") - F.col("_m")) * beta) * 100).alias("index_rel"),
    )
    w = Window.partitionBy("entity").orderBy("year")
    return d.withColumns(
        {f"chg_{n}": F.col("index_rel") - F.lag("index_rel", n).over(w) for n in (5, 10)}
    )


def leaders_laggards(df: DataFrame, n: int, key: str = "factor", value: str = "value") -> DataFrame:
    """Top and bottom n by summed return, NULL sums last."""
    s = df.groupBy(key).agg(F.sum(value).alias("total"), F.count(value).alias("n_obs"))
    top = s.orderBy(F.col("total").desc_nulls_last(), key).limit(n).withColumn("side", F.lit("leader"))
    low = s.orderBy(F.col("total").asc_nulls_last(), key).limit(n).withColumn("side", F.lit("laggard"))
    return top.unionByName(low)


def cross_source_discrepancy(a: DataFrame, b: DataFrame, months: int, tolerance: float) -> DataFrame:
    """Median absolute difference of two sources' month-end values over the recent months."""
    by = ["entity"]
    j = last_in_month(a, by).withColumnRenamed("value", "_a").join(
        last_in_month(b, by).withColumnRenamed("value", "_b"), ["entity", "month"]
    )
    end = j.agg(F.max("month").alias("_end"))
    d = j.join(end).filter(F.col("month") > F.add_months("_end", -months))
    d = d.withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    med = group_quantiles(d, by, "_d", {"median_abs_diff": 0.5})
    n = d.groupBy(*by).agg(F.count("*").alias("n"))
    return med.join(n, by).withColumn("breach", F.col("median_abs_diff") > tolerance)


def sentinel_check(df: DataFrame, sentinels: DataFrame, as_of: str, days: int) -> DataFrame:
    """Most recent value within ``days`` of a few named series against expectation."""
    cut = F.date_sub(F.lit(as_of).cast("date"), days)
    d = df.filter((F.col("date") >= cut) & (F.col("date") <= F.lit(as_of).cast("date")))
    last = d.groupBy("entity", "variable").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))
    j = sentinels.join(last, ["entity", "variable"], "left")
    return j.withColumn(
        "status",
        F.when(F.col("value").isNull(), "missing")
        .when(F.abs(F.col("value") - F.col("expected")) > F.col("tolerance"), "breach")
        .otherwise("ok"),
    )


def state_vector(df: DataFrame, keys: Sequence[str] = ("entity", "variable")) -> DataFrame:
    """Latest value of every variable of every entity."""
    return df.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.max_by("value", "date").alias("value"), F.max("date").alias("date")
    )


def entity_profile(state: DataFrame, edges: DataFrame, entity: str) -> DataFrame:
    """All latest values and all relations of one entity in one list."""
    a = state.filter(F.col("entity") == entity).select(
        F.lit("value").alias("kind"), F.col("variable").alias("name"), F.lit(None).cast("string").alias("other"), "value"
    )
    b = edges.filter(F.col("src") == entity).select(
        F.lit("out").alias("kind"), F.col("edge_type").alias("name"), F.col("dst").alias("other"), F.col("weight").alias("value")
    )
    c = edges.filter(F.col("dst") == entity).select(
        F.lit("in").alias("kind"), F.col("edge_type").alias("name"), F.col("src").alias("other"), F.col("weight").alias("value")
    )
    return a.unionByName(b).unionByName(c)


def holder_share(holdings: DataFrame, reporter: str, names: DataFrame | None = None) -> DataFrame:
    """One reporter's share of all inbound holdings, zero if absent, repeated over names."""
    s = holdings.groupBy("date", "dst").agg(
        F.sum("amount").alias("_t"),
        F.coalesce(F.sum(F.when(F.col("src") == reporter, F.col("amount"))), F.lit(0.0)).alias("_h"),
    ).filter(F.col("_t") > 0).select("date", F.col("dst").alias("code"), (F.col("_h") / F.col("_t") * 100).alias("value"))
    return s if names is None else s.join(names, "code")


def extremes_board(
    df: DataFrame, variables: Sequence[str], z_variables: Sequence[str], threshold: float, as_of: str, max_age: int
) -> DataFrame:
    """Latest values of chosen variables per entity where any z is extreme, with staleness."""
    at = F.lit(as_of).cast("date")
    d = df.filter(F.col("variable").isin(*variables) & (F.col("date") <= at) & F.col("value").isNotNull())
    last = d.groupBy("entity", "variable").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))
    p = last.groupBy("entity").agg(
        F.max("date").alias("date"), *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    )
    big = F.greatest(*[F.abs(F.coalesce(v, F.lit(0.0))) for v in z_variables]) if len(z_variables) > 1 else F.abs(
        F.coalesce(z_variables[0], F.lit(0.0))
    )
    return p.withColumns({"max_abs_z": big, "stale": F.datediff(at, "date") > max_age}).filter(
        F.col("max_abs_z") >= threshold
    )


def forward_calendar(events: DataFrame, categories: Sequence[str], as_of: str, minimum: int = 2) -> DataFrame:
    """Future events per category, every category listed, with a warning if too few."""
    c = events.filter(F.col("event_date") > F.lit(as_of).cast("date")).groupBy("category").agg(
        F.count("*").alias("n_ahead"), F.min("event_date").alias("next_date")
    )
    spine = events.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in categories])).alias("category"))
    return spine.join(c, "category", "left").select(
        "category", F.coalesce("n_ahead", F.lit(0)).cast("long").alias("n_ahead"), "next_date",
        (F.coalesce("n_ahead", F.lit(0)) < minimum).alias("warn"),
    )


def trial_conservation(hyp: DataFrame, old: str, new: str, charge: str = "charge") -> DataFrame:
    """Charged trials per family before and after a re-mapping; totals must agree."""
    a = hyp.groupBy(F.col(old).alias("family")).agg(F.sum(charge).alias("before"))
    b = hyp.groupBy(F.col(new).alias("family")).agg(F.sum(charge).alias("after"))
    j = a.join(b, "family", "full").na.fill(0.0, ["before", "after"])
    tot = j.agg(F.sum("before").alias("_b"), F.sum("after").alias("_a"))
    return j.join(tot).withColumn("conserved", F.abs(F.col("_b") - F.col("_a")) < 1e-9).drop("_a", "_b")


def variable_catalogue(df: DataFrame, as_of: str) -> DataFrame:
    c = coverage(df, ("variable",))
    return c.withColumn("days_stale", F.datediff(F.lit(as_of).cast("date"), "last_date").cast("long"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def composition_check(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Quality row per variable: duplicates, NULLs, values out of range."""
    d = df.groupBy("date", "entity", "variable").agg(
        F.count("*").alias("_c"), F.count(F.when(F.col("value").isNull(), 1)).alias("_nul"),
        F.count(F.when((F.col("value") < lo) | (F.col("value") > hi), 1)).alias("_out"),
    )
    return d.groupBy("variable").agg(
        F.sum("_c").alias("n_rows"), F.sum(F.when(F.col("_c") > 1, 1).otherwise(0)).alias("n_duplicate_keys"),
        F.sum("_nul").alias("n_null"), F.sum("_out").alias("n_out_of_range"),
    )
