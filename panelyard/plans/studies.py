"""Conditional studies: decile scans, event studies, regimes, fragility, history tails."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import before, guarded, last_rows, month_number, prior_rows, ratio, series, so_far
from ..functions.ranks import average_ranks, group_quantiles, least_from_here
from ..operators.features import (
    drawdown, expanding_percentile, full_sample_buckets, persistence, pit_buckets, rolling_abs_correlation,
)
from ..operators.normalise import cross_z, expanding_z, expanding_z_from_zero, peer_z, quantile_winsor
from ..session import settle
from .harness import align_monthly

COMBO = ("factor", "entity", "normalization", "horizon", "mode", "thresholds")


# --- decile scan --------------------------------------------------------------------------

def scan_records(panel: DataFrame, returns: DataFrame, horizons: Sequence[int], k: int = 10, warmup: int = 36, min_raw: int = 2) -> DataFrame:
    """Bucketed records of every (factor, entity, normalization, horizon, mode, thresholds).

    panel (factor, date, entity, value): raw values, expanding z and peer z are the three
    normalizations; forward returns are absolute and relative to the mean of the date;
    thresholds are point-in-time or whole-sample.
    """
    p = panel.filter(F.col("value").isNotNull())
    n = p.groupBy("factor", "entity").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_raw)
    p = p.join(n.select("factor", "entity"), ["factor", "entity"])
    keys = ["factor", "date", "entity"]
    raw = p.select(*keys, "value", F.lit("raw").alias("normalization"))
    hz = expanding_z_from_zero(p, ("factor", "entity")).select(*keys, F.col("z").alias("value"), F.lit("history_z").alias("normalization"))
    cz = peer_z(p, ("factor", "date")).filter(F.col("z").isNotNull()).select(*keys, F.col("z").alias("value"), F.lit("cross_z").alias("normalization"))
    sig = raw.unionByName(hz).unionByName(cz).withColumn("signal", F.concat_ws("|", "factor", "normalization"))
    al = settle(align_monthly(sig, returns, horizons))  # read by both threshold modes
    combo = ("factor", "entity", "normalization", "horizon")
    pit = pit_buckets(al.drop("signal"), k, warmup, combo).withColumn("thresholds", F.lit("pit"))
    full = full_sample_buckets(al.drop("signal"), k, combo).withColumn("thresholds", F.lit("full"))
    d = pit.unionByName(full.select(*pit.columns)).filter(F.col("bucket").isNotNull())
    ew = al.select("date", "entity", "horizon", "fwd_return").distinct().groupBy("date", "horizon").agg(F.avg("fwd_return").alias("_ew"))
    d = d.join(ew, ["date", "horizon"])
    modes = F.array(F.struct(F.lit("absolute").alias("m"), F.col("fwd_return").alias("f")), F.struct(F.lit("relative").alias("m"), (F.col("fwd_return") - F.col("_ew")).alias("f")))
    return d.withColumn("_m", F.explode(modes)).select(*combo, "date", "value", "bucket", "thresholds", F.col("_m.m").alias("mode"), F.col("_m.f").alias("fwd"))


def bucket_stats(records: DataFrame, by: Sequence[str] = COMBO) -> DataFrame:
    """Per bucket: n, mean, hit rate and overlap-adjusted t of the forward return."""
    g = records.groupBy(*by, "bucket").agg(
        F.count("*").alias("n"), F.avg("fwd").alias("avg_fwd"), F.avg((F.col("fwd") > 0).cast("double")).alias("hit"), F.stddev_samp("fwd").alias("_s"))
    neff = F.greatest(F.lit(2.0), F.col("n") / F.greatest(F.lit(1), F.col("horizon")))
    return g.withColumn("t_stat", F.when((F.col("n") >= 3) & (F.col("_s") > 0), F.col("avg_fwd") / (F.col("_s") / F.sqrt(neff)))).drop("_s")


def combo_stats(records: DataFrame, by: Sequence[str] = COMBO, k: int = 10) -> DataFrame:
    """Spearman IC and t, monotonic fit over bucket means, top-minus-bottom spread.

    Reads the records several times: settle or store them first when they are not a table.
    """
    by = list(by)
    r = average_ranks(average_ranks(records, by, "value", "_rx", "_n1"), by, "fwd", "_ry", "_n2")
    ic = r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("_ic"), F.count("*").alias("n_records"))
    neff = F.greatest(F.lit(4.0), F.col("n_records") / F.greatest(F.lit(1), F.col("horizon")))
    ic = ic.withColumn("ic", F.when((F.col("n_records") >= 6) & ~F.isnan("_ic"), F.col("_ic"))).withColumn(
        "ic_t", F.when(1 - F.col("ic") ** 2 > 0, F.col("ic") * F.sqrt((neff - 2) / (1 - F.col("ic") ** 2)))).drop("_ic")
    b = bucket_stats(records, by)
    fit = b.groupBy(*by).agg(
        F.regr_slope("avg_fwd", F.col("bucket").cast("double")).alias("slope"), F.regr_intercept("avg_fwd", F.col("bucket").cast("double")).alias("intercept"),
        F.regr_r2("avg_fwd", F.col("bucket").cast("double")).alias("r2"),
        (F.max(F.when(F.col("bucket") == k, F.col("avg_fwd"))) - F.max(F.when(F.col("bucket") == 1, F.col("avg_fwd")))).alias("spread"))
    return ic.filter(F.col("n_records") >= 2).join(fit, by)


def scan(records: DataFrame, current: DataFrame, by: Sequence[str] = COMBO, k: int = 10) -> DataFrame:
    """One row per combination: statistics, the current bucket's history, direction, scores.

    ``current``: (combo keys without mode, current_bucket) of each series' latest signal.
    """
    by = list(by)
    keys = [c for c in by if c != "mode"]
    b = bucket_stats(records, by)
    s = combo_stats(records, by, k).join(current.select(*keys, "current_bucket"), keys)
    s = s.join(b.withColumnsRenamed({"bucket": "current_bucket", "n": "cur_n", "avg_fwd": "cur_avg", "hit": "cur_hit", "t_stat": "cur_t"}), [*by, "current_bucket"], "left")
    pred = F.col("slope") * F.col("current_bucket") + F.col("intercept")
    direction = (
        F.when(F.col("cur_avg").isNull() | (F.col("cur_n") < 5), "insufficient").when(F.col("cur_avg") > 0, "long").when(F.col("cur_avg") < 0, "short").otherwise("neutral"))
    s = s.withColumns({
        "direction": direction,
        "aligned": F.coalesce((F.signum(pred) == F.signum("cur_avg")) & (pred != 0), F.lit(False)).cast("int"),
        "sample_score": F.least(F.lit(1.0), F.coalesce("cur_n", F.lit(0)) / 20),
        "ic_score": F.coalesce(F.least(F.lit(1.0), F.abs("ic_t") / 2.5), F.lit(0.0)),
        "hit_score": F.coalesce(F.abs(F.col("cur_hit") - 0.5) * 2, F.lit(0.0)),
    })
    sib = [c for c in by if c != "horizon"]
    w, same = Window.partitionBy(*sib), Window.partitionBy(*sib, "direction")
    n = F.count("*").over(w)
    taken = F.col("direction").isin("long", "short")
    s = s.withColumn("horizon_agreement", F.when((n > 1) & taken, (F.count("*").over(same) - 1) / (n - 1)).otherwise(0.0))
    conf = (F.col("sample_score") + F.col("ic_score") + F.col("hit_score") + F.col("horizon_agreement")) / 4 * F.col("aligned")
    return s.withColumn("confidence", F.when(F.col("thresholds") == "pit", F.round(conf, 4)).otherwise(0.0))


def current_buckets(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bucket of each series' latest bucketed record."""
    return records.groupBy(*keys).agg(F.max_by("bucket", "date").alias("current_bucket"))


def opportunity_queue(rows: DataFrame, min_records: int, min_t: float, min_r2: float, min_confidence: float, cap: int, min_bucket: int = 5, low: int = 1, high: int = 10) -> DataFrame:
    """Strong, extreme point-in-time rows, one per (entity, factor), strongest ``cap`` first."""
    d = rows.filter(
        (F.col("thresholds") == "pit") & (F.col("n_records") >= min_records) & (F.col("cur_n") >= min_bucket) & (F.abs("ic_t") >= min_t) & (F.coalesce("r2", F.lit(0.0)) >= min_r2)
        & F.col("direction").isin("long", "short") & ((F.col("current_bucket") <= low) | (F.col("current_bucket") >= high)) & (F.col("confidence") >= min_confidence))
    d = d.withColumn("priority", F.col("confidence") * F.least(F.abs("ic_t"), F.lit(6.0)) / 6 * F.least("r2", F.lit(1.0)))
    o = [F.col("priority").desc(), "normalization", "mode", "horizon"]
    w = Window.partitionBy("entity", "factor").orderBy(*o)
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.col("priority").desc(), "entity", "factor").limit(cap)


def prior_history(records: DataFrame, by: Sequence[str] = COMBO, lag_months: int = 1) -> DataFrame:
    """Bucket history known at every evaluation month, and the signal's bucket then.

    A record of month M and horizon h is complete at M+h.  Each record is placed on its
    completion month; running sums per (combo, bucket) give n, mean and hit at every such
    month, and the signal known at T (label <= T - lag) reads its bucket's row.
    """
    by = list(by)
    d = records.withColumn("_done", month_number("date") + F.col("horizon"))
    w = Window.partitionBy(*by, "bucket").orderBy("_done").rangeBetween(Window.unboundedPreceding, 0)
    hist = d.select(*by, "bucket", "_done", "fwd").withColumns(
        {"n": F.count("*").over(w), "_s": F.sum("fwd").over(w), "_h": F.sum((F.col("fwd") > 0).cast("long")).over(w)}
    ).drop("fwd").distinct()
    # evaluation: the signal labelled M becomes usable at T = M + lag
    ev = d.select(*by, "bucket", (month_number("date") + lag_months).alias("_t"), "date")
    u = ev.select(*by, "bucket", "_t", F.lit(1).alias("_k"), "date", *[F.lit(None).cast("double").alias(c) for c in ("n", "_s", "_h")]).unionByName(
        hist.select(*by, "bucket", F.col("_done").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("date").alias("date"), F.col("n").cast("double").alias("n"), F.col("_s"), F.col("_h").cast("double").alias("_h")))
    o = Window.partitionBy(*by, "bucket").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    r = u.withColumns({c: F.last(c, ignorenulls=True).over(o) for c in ("n", "_s", "_h")}).filter("_k = 1 AND n IS NOT NULL")
    return r.select(*by, "date", "bucket", F.col("n").cast("long").alias("n"), (F.col("_s") / F.col("n")).alias("avg_fwd"), (F.col("_h") / F.col("n")).alias("hit"))


# --- event study --------------------------------------------------------------------------

def abnormal(returns: DataFrame) -> DataFrame:
    m = returns.filter(F.col("ret").isNotNull()).groupBy("date").agg(F.avg("ret").alias("_m"))
    return returns.filter(F.col("ret").isNotNull()).join(m, "date").select("date", "entity", (F.col("ret") - F.col("_m")).alias("ar"))


def event_paths(events: DataFrame, returns: DataFrame, pre: int, post: int, next_month: bool = False, max_missing: float = 0.4) -> DataFrame:
    """Cumulative abnormal return of each event at offsets -pre..post, 0 at the anchor.

    events (event, date, entity, sign); the anchor is the last calendar date not after the
    event (or its month end).  Windows must lie inside the calendar and mostly trade.
    """
    cal = returns.select("date").distinct().withColumn("_p", F.row_number().over(Window.orderBy("date")) - 1)
    n = cal.agg(F.count("*").alias("_n"))
    know = F.last_day("date") if next_month else F.col("date")
    ev = events.select("event", "entity", "sign", know.alias("_k"))
    # anchor position of each distinct date from the short calendar
    u = ev.select(F.col("_k").alias("_d")).distinct().withColumns({"_s": F.lit(1), "_p": F.lit(None).cast("int")}).unionByName(
        cal.select(F.col("date").alias("_d"), F.lit(0).alias("_s"), "_p"))
    a = u.withColumn("_a", F.last("_p", ignorenulls=True).over(Window.orderBy("_d", "_s").rowsBetween(Window.unboundedPreceding, 0))).filter("_s = 1").select(F.col("_d").alias("_k"), "_a")
    ev = ev.join(a, "_k").join(n).filter((F.col("_a") >= pre) & (F.col("_a") + post < F.col("_n")))
    ar = abnormal(returns).join(cal, "date").select("entity", "_p", "ar")
    grid = ev.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("_p", F.col("_a") + F.col("offset"))
    g = grid.join(ar, ["entity", "_p"], "left")
    w = Window.partitionBy("event", "entity")
    run = F.sum(F.coalesce(F.col("ar") * F.col("sign"), F.lit(0.0))).over(w.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumns({"_c": run, "_miss": F.avg(F.col("ar").isNull().cast("double")).over(w)}).filter(F.col("_miss") <= max_missing)
    base = F.max(F.when(F.col("offset") == 0, F.col("_c"))).over(w)
    return g.withColumn("car", F.col("_c") - base).select("event", "entity", "offset", "car")


def path_statistics(paths: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean, median, t, p, hit rate per horizon, and the run-up before the anchor."""
    from ..functions.small_stats import t_pvalue

    lo = paths.agg(F.min("offset").alias("_lo"))
    d = paths.join(lo).withColumn("value", F.when(F.col("offset") == F.col("_lo"), -F.col("car")).otherwise(F.col("car")))
    d = d.withColumn("label", F.when(F.col("offset") == F.col("_lo"), "runup").otherwise(F.concat(F.lit("+"), F.col("offset").cast("string"))))
    d = d.filter((F.col("label") == "runup") | F.col("offset").isin(*horizons))
    med = group_quantiles(d, ["label"], "value", {"median_car": 0.5})
    s = F.stddev_samp("value")
    g = d.groupBy("label").agg(F.avg("value").alias("mean_car"), F.avg((F.col("value") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n_events"), s.alias("_s"))
    t = F.when((F.col("n_events") >= 5) & (F.col("_s") > 0), F.col("mean_car") / (F.col("_s") / F.sqrt("n_events")))
    g = g.join(med, "label").withColumn("t_stat", t)
    return g.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("n_events") - 1)).drop("_s")


def replicate_counts(df: DataFrame, key: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """Poisson(1) resampling counts per (row key, replicate), a function of the key alone.

    The count comes from a hash, so the replicates are the same under any partitioning and
    after any recomputation; their means follow the same law as resampling with replacement.
    """
    d = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = (F.xxhash64(*key, F.col("replicate"), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    p, cum, count = math.exp(-1), 0.0, F.lit(0)
    for k in range(12):
        cum += p
        count = count + (u >= cum).cast("int")
        p /= k + 1
    return d.withColumn("w", count)


def bootstrap_band(paths: DataFrame, replicates: int = 500, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile band of the mean path by resampling events."""
    r = replicate_counts(paths.select("event", "entity").distinct(), ["event", "entity"], replicates).filter("w > 0")
    m = paths.join(r, ["event", "entity"]).groupBy("offset", "replicate").agg((F.sum(F.col("car") * F.col("w")) / F.sum("w")).alias("m"))
    return group_quantiles(m, ["offset"], "m", {"lo": lo, "hi": hi})


def clustered_mean_difference(df: DataFrame, diff: str, cluster: str, replicates: int = 500, by: Sequence[str] = ()) -> DataFrame:
    """Mean of a difference with a cluster-bootstrap interval: clusters are reduced to sums
    before they are resampled."""
    by = list(by)
    c = df.groupBy(*by, cluster).agg(F.sum(diff).alias("_s"), F.count(diff).alias("_n"))
    m = c.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean_diff"), F.sum("_n").alias("n"), F.count("*").alias("n_clusters"))
    r = replicate_counts(c, [*by, cluster], replicates).filter("w > 0").groupBy(*by, "replicate").agg((F.sum(F.col("_s") * F.col("w")) / F.sum(F.col("_n") * F.col("w"))).alias("m"))
    q = group_quantiles(r.withColumn("_k", F.lit(1)), [*by, "_k"], "m", {"ci_lo": 0.025, "ci_hi": 0.975}).drop("_k")
    return m.join(q, by) if by else m.join(q)


def leave_one_cluster_out(df: DataFrame, diff: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean without each cluster, from totals minus the cluster."""
    by = list(by)
    c = df.groupBy(*by, cluster).agg(F.sum(diff).alias("_s"), F.count(diff).alias("_n"))
    t = c.groupBy(*by).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    j = c.join(t, by) if by else c.join(t)
    return j.select(*by, cluster, (F.col("_ts") / F.col("_tn")).alias("full"), F.when(F.col("_tn") > F.col("_n"), (F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("without"))


# --- regimes ------------------------------------------------------------------------------

def tag_regimes(m: DataFrame) -> DataFrame:
    """Ordered rules on one macro row per date, first match wins."""
    w = Window.orderBy("date")  # one row per date
    d = m.withColumn("_vix3", F.lag("vix", 3).over(w))
    v, oas, curve, fed, cpi, s = (F.col(c) for c in ("vix", "baa_oas", "yield_2s10s", "fed_funds_chg_12m", "cpi_yoy", "umcsent"))
    true = lambda c: F.coalesce(c, F.lit(False))
    crisis = true(v > 30) | true(oas > 3.5) | true((v > 25) & (oas > 2.5))
    recession = true(F.col("nber_recession") == 1) | true(F.col("sahm_triggered") == 1)
    late = true((fed > 0) & (curve < 0.50) & (v < 25) & (oas < 2.5))
    met = sum(true(c).cast("int") for c in ((F.col("_vix3") > 25) & (v < 22), F.col("baa_oas_chg_3m") < 0, F.col("umcsent_chg_3m") > 0))
    expansion = true((v < 20) & (curve > 0.50) & (s > 90) & (F.col("nber_recession") == 0))
    stagflation = true((cpi > 4) & (s < 70))
    rule = (
        F.when(crisis, "R1_Crisis").when(recession, "R3_Recession").when(late, "R2_Late-cycle").when(met >= 2, "R4_Recovery")
        .when(expansion, "R5_Expansion").when(stagflation, "R6_Stagflation").otherwise("R7_Transition"))
    label = F.create_map(*[F.lit(x) for kv in (("R1_Crisis", "Crisis"), ("R3_Recession", "Recession"), ("R2_Late-cycle", "Late-cycle"), ("R4_Recovery", "Expansion"), ("R5_Expansion", "Expansion"), ("R6_Stagflation", "Late-cycle"), ("R7_Transition", "Transition")) for x in kv])
    return d.withColumn("rule", rule).withColumn("regime", label[F.col("rule")]).drop("_vix3")


def one_way_f(df: DataFrame, by: Sequence[str], group: str, value: str, minimum: int = 5) -> DataFrame:
    """F statistic and p-value of group means, from group counts, means and variances."""
    from ..functions.small_stats import f_pvalue

    by = list(by)
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")).filter(F.col("_n") >= minimum)
    n, nm, nm2, ss = F.sum("_n"), F.sum(F.col("_n") * F.col("_m")), F.sum(F.col("_n") * F.col("_m") ** 2), F.sum(F.col("_n") * F.col("_v"))
    a = g.groupBy(*by).agg(n.alias("_N"), (nm2 - nm * nm / n).alias("_ssb"), ss.alias("_ssw"), F.count("*").alias("_k"))
    a = a.withColumn("f_stat", F.when((F.col("_k") >= 2) & (F.col("_N") > F.col("_k")), (F.col("_ssb") / (F.col("_k") - 1)) / (F.col("_ssw") / (F.col("_N") - F.col("_k")))))
    return a.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("_k") - 1, F.col("_N") - F.col("_k"))).select(*by, "f_stat", "p_value")


def bh_adjust(df: DataFrame, p: str = "p_value", alpha: float = 0.20, key: str = "factor") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values (one row per tested factor).

    The running minimum from the largest p-value down is a two-level scan over ranges of p.
    """
    d = least_from_here(df.filter(F.col(p).isNotNull()), [], [p, key], lambda r, m: F.col(p) * m / r, "p_adj")
    d = d.withColumn("p_adj", F.least(F.lit(1.0), F.col("p_adj")))
    return d.withColumn("significant", F.col("p_adj") <= alpha)


def conditional_ic(ic: DataFrame, regimes: DataFrame, alpha: float = 0.20) -> DataFrame:
    """IC by regime: F test, adjusted p, dispersion and sign reversal per factor."""
    m = ic.join(regimes.select("date", "regime"), "date")
    g = m.groupBy("factor", "regime").agg(F.avg("ic").alias("_m"))
    d = g.groupBy("factor").agg(F.stddev_samp("_m").alias("ic_dispersion"), ((F.max("_m") > 0) & (F.min("_m") < 0) & (F.count("*") >= 2)).alias("sign_reversal"))
    u = m.groupBy("factor").agg(F.avg("ic").alias("ic_unconditional"))
    return bh_adjust(one_way_f(m, ["factor"], "regime", "ic"), alpha=alpha).join(d, "factor").join(u, "factor")


def expanding_regime(df: DataFrame, warmup_months: int = 60, low: float = 0.3, high: float = 0.7, lag_months: int = 0) -> DataFrame:
    """Growth / Recession / Neutral by the inclusive expanding percentile, once the series
    spans the warm-up; labels are usable ``lag_months`` later."""
    p = expanding_percentile(df, 3, True, ("entity",))
    first = F.min("date").over(series(["entity"]))
    span = (month_number("date") - F.year("_f") * 12 - F.month("_f"))
    p = p.withColumn("_f", first).filter((span >= warmup_months) & F.col("pct").isNotNull())
    return p.select("entity", F.add_months("date", lag_months).alias("date"), "pct", F.when(F.col("pct") <= low, "Recession").when(F.col("pct") >= high, "Growth").otherwise("Neutral").alias("regime"))


def standardised_ranks(panel: DataFrame, minimum: int = 10) -> DataFrame:
    """Per (factor, date): average ranks of signal and return, standardised (sample)."""
    by = ["factor", "date"]
    d = settle(panel.filter(F.col("signal").isNotNull() & F.col("ret").isNotNull()))
    r = average_ranks(average_ranks(d, by, "signal", "_a", "_n"), by, "ret", "_b", "_n2").filter(F.col("_n") >= minimum)
    z = cross_z(cross_z(r, by, "_a", 1, out="rank_signal"), by, "_b", 1, out="rank_ret")
    return z.filter(F.col("rank_signal").isNotNull() & F.col("rank_ret").isNotNull()).select(*by, "entity", "rank_signal", "rank_ret")


def interaction_test(ranked: DataFrame, regimes: DataFrame, replicates: int = 199, min_cell: int = 30, seed: int = 42, placebo: int = 0) -> DataFrame:
    """Joint F of regime interactions per factor with a wild cluster bootstrap p-value.

    Everything a replicate needs is linear in per-entity cross-products: one aggregate per
    (factor, entity) holds X'X and X'y pieces, so the solver sees entities, not rows.
    ``placebo`` > 0 shuffles regimes over dates by hash.
    """
    reg = regimes.select("entity", "date", "regime")
    if placebo:
        # the label of a date moves to another date of the same entity, by hash order
        a = reg.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("date")))
        b = reg.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy(F.xxhash64("entity", "date", F.lit(placebo))))).select("entity", "_i", F.col("regime").alias("_new"))
        reg = a.join(b, ["entity", "_i"]).select("entity", "date", F.col("_new").alias("regime"))
    d = ranked.join(reg.filter(F.col("regime").isin("Growth", "Recession", "Neutral")), ["entity", "date"])
    g, c = (F.col("regime") == "Growth").cast("double"), (F.col("regime") == "Recession").cast("double")
    x = [F.lit(1.0), F.col("rank_signal"), F.col("rank_signal") * g, F.col("rank_signal") * c]
    y = F.col("rank_ret")
    cols = [F.sum(x[i] * x[j]).alias(f"x{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(x[i] * y).alias(f"y{i}") for i in range(4)]
    agg = d.groupBy("factor", "entity").agg(
        *cols, F.sum(y * y).alias("yy"), F.count("*").alias("n"), F.sum(g).alias("ng"), F.sum(c).alias("nr"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("entity")
        k = len(p)
        xx = np.zeros((k, 4, 4))
        for i in range(4):
            for j in range(i, 4):
                xx[:, i, j] = xx[:, j, i] = p[f"x{i}{j}"]
        xy = p[[f"y{i}" for i in range(4)]].to_numpy()
        yy, n = p["yy"].to_numpy(), int(p["n"].sum())
        cells = (int(p["ng"].sum()), int(p["nr"].sum()), int(n - p["ng"].sum() - p["nr"].sum()))
        X, Y = xx.sum(0), xy.sum(0)
        res = {"factor": p["factor"].iloc[0], "n_obs": n, "n_entities": k, "growth_coef": np.nan, "recession_coef": np.nan, "f_stat": np.nan, "p_boot": np.nan, "included": False}
        if min(cells) < min_cell:
            return pd.DataFrame([res])
        giu, gir = np.linalg.pinv(X), np.linalg.pinv(X[:2, :2])

        def fstat(b: np.ndarray, q: np.ndarray) -> np.ndarray:
            ru = q - np.einsum("...i,ij,...j->...", b, giu, b)
            rr = q - np.einsum("...i,ij,...j->...", b[..., :2], gir, b[..., :2])
            return ((rr - ru) / 2) / (ru / (n - 4))

        bu, br = giu @ Y, gir @ Y[:2]
        f0 = fstat(Y, yy.sum())
        # null fit Xr br and residual e per entity: pieces of X'(Xr br + w e) and its square
        fit = xx[:, :, :2] @ br                      # X' X_r b per entity
        e = xy - fit                                 # X' e per entity
        fitfit = np.einsum("i,kij,j->k", br, xx[:, :2, :2], br)
        cross = xy[:, :2] @ br - fitfit              # (X_r b)' e per entity
        ee = yy - 2 * (xy[:, :2] @ br) + fitfit
        rng = np.random.default_rng(seed)
        parts = []
        for _ in range(replicates):  # one weight vector at a time: memory stays one row per entity
            w = rng.choice([-1.0, 1.0], size=k)
            parts.append(fstat(fit.sum(0) + w @ e, fitfit.sum() + 2 * (w @ cross) + ee.sum()))
        fb = np.array(parts)
        fb = fb[np.isfinite(fb)]
        res.update(growth_coef=bu[2], recession_coef=bu[3], f_stat=f0, p_boot=(1 + int((fb >= f0).sum())) / (1 + len(fb)), included=True)
        return pd.DataFrame([res])

    schema = "factor string, n_obs long, n_entities long, growth_coef double, recession_coef double, f_stat double, p_boot double, included boolean"
    return agg.groupBy("factor").applyInPandas(solve, schema)


# --- hidden states ------------------------------------------------------------------------

def _gaussian_hmm(x: np.ndarray, k: int, iterations: int = 200, tol: float = 1e-4):
    """Diagonal Gaussian hidden Markov model by EM, started from ordered quantile blocks:
    state probabilities, BIC and whether the likelihood settled."""
    n, d = x.shape
    order = np.argsort(x[:, 0], kind="stable")
    r = np.zeros((n, k))
    for s, idx in enumerate(np.array_split(order, k)):
        r[idx, s] = 1.0
    start, trans = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(trans, 0.9)
    mean = (r.T @ x) / r.sum(0)[:, None]
    var = np.maximum((r.T @ x**2) / r.sum(0)[:, None] - mean**2, 1e-4)
    last, settled = -np.inf, False
    for _ in range(iterations):
        logp = -0.5 * (((x[:, None, :] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
        top = logp.max(1, keepdims=True)
        b = np.exp(logp - top)
        a, c = np.zeros((n, k)), np.zeros(n)
        a[0] = start * b[0]
        c[0] = a[0].sum()
        a[0] /= c[0]
        for i in range(1, n):
            a[i] = (a[i - 1] @ trans) * b[i]
            c[i] = a[i].sum()
            a[i] /= c[i]
        be = np.ones((n, k))
        for i in range(n - 2, -1, -1):
            be[i] = trans @ (b[i + 1] * be[i + 1]) / c[i + 1]
        post = a * be
        post /= post.sum(1, keepdims=True)
        xi = np.einsum("ti,ij,tj->ij", a[:-1], trans, (b[1:] * be[1:]) / c[1:, None])
        ll = float(np.log(c).sum() + top.sum())
        if ll - last < tol:
            settled = True
            break
        last = ll
        start, trans = post[0], xi / xi.sum(1, keepdims=True)
        w = post.sum(0)[:, None]
        mean = (post.T @ x) / w
        var = np.maximum((post.T @ x**2) / w - mean**2, 1e-4)
    params = (k - 1) + k * (k - 1) + 2 * k * d
    return post, -2 * ll + params * math.log(n), settled


def hidden_states(features: DataFrame, returns: DataFrame, columns: Sequence[str], min_train: int = 60, refit_month: int = 1, states: Sequence[int] = (2, 3)) -> DataFrame:
    """Walk-forward adverse-state probability per entity.

    features (entity, date, columns), standardised and without NULLs; returns (entity, date,
    ret) are forward returns.  One task fits one (entity, refit year) on that entity's
    history up to the refit date and scores the months until the next refit; the state with
    the lowest mean forward return completed by then is adverse.
    """
    d = features.join(returns.select("entity", "date", F.col("ret").alias("_r")), ["entity", "date"], "left")
    years = d.select("entity", F.year("date").alias("_y")).distinct()
    # a fit of year Y sees all rows before the end of Y: replicate by year (calendar-bounded)
    grid = d.join(years, "entity").filter(F.year("date") <= F.col("_y"))
    kind = features.schema["entity"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        year = int(pdf["_y"].iloc[0])
        y = pd.to_datetime(pdf["date"]).dt.year.to_numpy()
        train = y < year
        out = {"entity": [], "date": [], "n_states": [], "p_adverse": [], "converged": []}
        # a model needs more rows than parameters
        fits = [k for k in states if train.sum() > (k - 1) + k * (k - 1) + 2 * k * len(columns)]
        if train.sum() >= min_train and fits:
            x = pdf[list(columns)].to_numpy(float)
            post, bic, settled, k = min(((*_gaussian_hmm(x[train], k), k) for k in fits), key=lambda r: r[1])
            lab = post.argmax(1)
            rets = pdf["_r"].to_numpy(float)[train][:-1]  # the last label's return is not known yet
            means = [np.nanmean(rets[lab[:-1] == s]) if np.isfinite(rets[lab[:-1] == s]).any() else np.inf for s in range(k)]
            bad = int(np.argmin(means))
            mu = np.array([x[train][lab == s].mean(0) if (lab == s).any() else np.full(x.shape[1], 1e6) for s in range(k)])
            sd = np.array([x[train][lab == s].std(0) + 1e-2 if (lab == s).any() else np.ones(x.shape[1]) for s in range(k)])
            trans = np.full((k, k), 1e-3)
            np.add.at(trans, (lab[:-1], lab[1:]), 1.0)
            trans /= trans.sum(1, keepdims=True)
            belief = post[-1]
            for i in np.flatnonzero(~train):
                lp = -0.5 * ((x[i] - mu) ** 2 / sd**2).sum(1) - np.log(sd).sum(1)
                b = (belief @ trans) * np.exp(lp - lp.max())
                belief = b / b.sum()
                out["entity"].append(pdf["entity"].iloc[i]); out["date"].append(pdf["date"].iloc[i])
                out["n_states"].append(k); out["p_adverse"].append(float(belief[bad]))
                out["converged"].append(settled)
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    return grid.groupBy("entity", "_y").applyInPandas(fit, f"entity {kind}, date date, n_states long, p_adverse double, converged boolean")


def warning_gates(states: DataFrame, returns: DataFrame, replicates: int = 200, lead: int = 3) -> DataFrame:
    """Persistence, volatility-disguise, lead and shuffle gates of an adverse-state signal.

    states (entity, date, p_adverse); returns backward-labelled monthly.
    """
    s = states.withColumn("state", (F.col("p_adverse") >= 0.5).cast("string"))
    pers = persistence(s, (1,)).select("entity", "persist_1", "mean_duration")
    w = Window.partitionBy("entity").orderBy("date")
    r = returns.withColumns({"_vol": guarded(F.stddev_samp("ret").over(last_rows(w, 6)), "ret", last_rows(w, 6), 6), "_fwd": F.expm1(F.sum(F.log1p("ret")).over(w.rowsBetween(1, lead)))})
    j = s.join(r.select("entity", "date", "_vol", "_fwd"), ["entity", "date"])
    base = j.groupBy("entity").agg(F.corr("p_adverse", "_vol").alias("corr_volatility"), F.corr("p_adverse", "_fwd").alias("corr_forward"), F.count("*").alias("n"))
    # shuffle gate: forward returns re-paired by hash order within the entity
    i = j.filter(F.col("_fwd").isNotNull()).withColumn("_i", F.row_number().over(w))
    rep = i.select("entity", "_fwd", "date").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    sh = rep.withColumn("_i", F.row_number().over(Window.partitionBy("entity", "replicate").orderBy(F.xxhash64("entity", "date", "replicate"))))
    c = sh.join(i.select("entity", "_i", "p_adverse"), ["entity", "_i"]).groupBy("entity", "replicate").agg(F.corr("p_adverse", "_fwd").alias("c"))
    p = c.join(base.select("entity", "corr_forward"), "entity").groupBy("entity").agg(F.avg((F.col("c") <= F.col("corr_forward")).cast("double")).alias("shuffle_p"))
    return base.join(pers, "entity").join(p, "entity")


# --- fragility ----------------------------------------------------------------------------

def fragility_component(df: DataFrame, sign: int, lo: float = 0.01, hi: float = 0.99, minimum: int = 24, invert_cs: bool = False) -> DataFrame:
    """Winsorise per date, z across entities, then expanding z per entity, signed."""
    d = quantile_winsor(df.filter(F.col("value").isNotNull()), lo, hi, ("date",))
    d = cross_z(d, ("date",), ddof=0, out="cs")
    t = expanding_z(d, minimum, ("entity",), "cs", on_zero=None, ddof=0, out="ts")
    return t.select("date", "entity", "cs", (F.col("ts") * sign).alias("component"))


def fragility_composite(parts: dict[str, DataFrame], minimum: int = 3) -> DataFrame:
    """Mean of the components present per (date, entity), at least ``minimum`` of them."""
    out = None
    for name, d in parts.items():
        p = d.filter(F.col("component").isNotNull()).select("date", "entity", F.lit(name).alias("name"), "component")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("date", "entity").agg(F.avg("component").alias("composite"), F.count("*").alias("n_components")).filter(F.col("n_components") >= minimum)


def walk_forward_quartiles(df: DataFrame, value: str = "composite", min_prior: int = 60) -> DataFrame:
    """Label each year's rows bottom / top by the quartiles of all earlier years.

    The cut of year Y needs the values before Y: rows are replicated to the (few) later years
    they serve, and cut points come from exact positions per year.
    """
    years = df.select(F.year("date").alias("_Y")).distinct()
    span = years.agg(F.max("_Y").alias("_last"))
    prior = df.select(F.col(value).alias("_x"), F.year("date").alias("_y")).join(span).withColumn("_Y", F.explode(F.when(F.col("_y") < F.col("_last"), F.sequence(F.col("_y") + 1, F.col("_last")))))
    n = prior.groupBy("_Y").agg(F.count("_x").alias("_n")).filter(F.col("_n") >= min_prior)
    cuts = group_quantiles(prior, ["_Y"], "_x", {"_q1": 0.25, "_q3": 0.75}).join(n, "_Y")
    d = df.withColumn("_Y", F.year("date")).join(cuts, "_Y")
    return d.withColumn("side", F.when(F.col(value) <= F.col("_q1"), "bottom").when(F.col(value) >= F.col("_q3"), "top")).drop("_Y", "_q1", "_q3", "_n")


def pooled_test(labelled: DataFrame, fwd: str = "fwd", value: str = "composite") -> DataFrame:
    """Per year: bottom and top mean forward return, spread; and the share of negative
    spreads (top below bottom) over years."""
    y = labelled.filter(F.col(fwd).isNotNull()).groupBy(F.year("date").cast("long").alias("year")).agg(
        F.avg(F.when(F.col("side") == "bottom", F.col(fwd))).alias("bottom"), F.avg(F.when(F.col("side") == "top", F.col(fwd))).alias("top"), F.corr(value, fwd).alias("corr"), F.count("*").alias("n"))
    return y.withColumn("spread", F.col("top") - F.col("bottom"))


def volatility_gate(df: DataFrame, returns: DataFrame, value: str = "composite", minimum: int = 24, window: int = 6) -> DataFrame:
    """Correlation of a signal with the trailing volatility realised before it, per entity."""
    f = prior_rows(Window.partitionBy("entity").orderBy("date"), window)
    r = returns.withColumn("_v", guarded(F.stddev_samp("ret").over(f), "ret", f, window))
    j = df.join(r.select("entity", "date", "_v"), ["entity", "date"]).filter(F.col("_v").isNotNull() & F.col(value).isNotNull())
    return j.groupBy("entity").agg(F.count("*").alias("n"), F.corr(value, "_v").alias("_c")).select("entity", "n", F.when(F.col("n") >= minimum, F.col("_c")).alias("corr_vol"))


# --- macro-history tails ------------------------------------------------------------------

# Drawdown buckets (above, up to and including) and the inflation bound.
DRAWDOWN_BUCKETS = (("dd_0_10", -0.10, 0.0), ("dd_10_20", -0.20, -0.10), ("dd_20_35", -0.35, -0.20), ("dd_35_plus", -1.01, -0.35))
HYPERINFLATION = 0.5


def real_returns(df: DataFrame) -> DataFrame:
    """(entity, year, eq_tr, bond_tr, bill_rate, cpi, crisis) -> real returns and drawdown."""
    w = Window.partitionBy("entity").orderBy("year")
    d = df.withColumn("infl", ratio(F.col("cpi"), F.lag("cpi").over(w)) - 1)
    d = d.withColumns({n: (1 + F.col(c)) / (1 + F.col("infl")) - 1 for n, c in (("equity", "eq_tr"), ("bond", "bond_tr"), ("bill", "bill_rate"))})
    d = d.withColumn("_i", F.exp(F.sum(F.log1p(F.coalesce("equity", F.lit(0.0)))).over(so_far(w))))
    return d.withColumn("drawdown", F.col("_i") / F.max("_i").over(so_far(w)) - 1).drop("_i")


def drawdown_state(dd: Column) -> Column:
    x = F.least(dd, F.lit(0.0))
    return F.when(x <= -0.35, "dd_35_plus").when(x <= -0.20, "dd_20_35").when(x <= -0.10, "dd_10_20").otherwise("dd_0_10")


def history_tails(df: DataFrame, horizons: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Percentiles of annualised real forward returns by state, asset, horizon and variant."""
    w = Window.partitionBy("entity").orderBy("year")
    r = real_returns(df)
    crisis = F.coalesce(F.col("crisis") == 1, F.lit(False))
    post = F.coalesce(F.max(crisis.cast("int")).over(w.rangeBetween(-3, -1)) == 1, F.lit(False))
    states = [F.struct(F.lit("normal").alias("s"), ((F.col("drawdown") > -0.10) & ~crisis).alias("on")), F.struct(F.lit("banking_crisis").alias("s"), crisis.alias("on")), F.struct(F.lit("post_crisis_1_3y").alias("s"), F.col("_post").alias("on"))]
    states += [F.struct(F.lit(n).alias("s"), ((F.col("drawdown") > lo) & (F.col("drawdown") <= hi)).alias("on")) for n, lo, hi in DRAWDOWN_BUCKETS]
    r = r.withColumn("_post", post)
    cells = []
    for a in ("equity", "bond", "bill"):
        for h in horizons:
            f = w.rowsBetween(1, h)
            full = F.count(a).over(f) == h
            cum = F.exp(F.sum(F.log1p(F.col(a))).over(f) / h) - 1
            hyper = F.coalesce(F.max((F.abs("infl") > HYPERINFLATION).cast("int")).over(f) == 1, F.lit(False))
            cells.append(F.struct(F.lit(a).alias("asset"), F.lit(h).alias("h"), F.when(full, cum).alias("x"), hyper.alias("hyper")))
    r = r.withColumn("_c", F.array(*cells)).withColumn("_st", F.explode(F.array(*states)))
    r = r.select("entity", "year", F.col("_st.s").alias("state"), F.coalesce("_st.on", F.lit(False)).alias("on"), "_c")
    prev = F.coalesce(F.lag("on").over(Window.partitionBy("entity", "state").orderBy("year")), F.lit(False))
    r = settle(r.withColumn("_edge", F.col("on") & ~prev))
    ep = r.groupBy("state").agg(F.sum(F.col("_edge").cast("long")).alias("n_episodes"))
    c = r.filter("on").withColumn("_x", F.explode("_c")).select("state", F.col("_x.asset").alias("asset"), F.col("_x.h").alias("horizon"), F.col("_x.x").alias("x"), F.col("_x.hyper").alias("hyper")).filter(F.col("x").isNotNull())
    variants = F.when(F.col("hyper"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("ex_hyperinflation")))
    c = c.withColumn("variant", F.explode(variants))
    k = ["state", "asset", "horizon", "variant"]
    q = group_quantiles(c, k, "x", {"p10": 0.10, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    m = c.groupBy(*k).agg(F.count("*").alias("n_obs"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.avg((F.col("x") < 0).cast("double")).alias("prob_neg"))
    return m.join(q, k).join(ep, "state")


def current_tails(returns: DataFrame, tails: DataFrame, asset: str = "equity", horizon: int = 3, lookback: int = 1260, minimum: int = 60) -> DataFrame:
    """Each entity's drawdown over its trailing window and the history of that state."""
    back = Window.partitionBy("entity").orderBy(F.col("date").desc())
    r = returns.filter(F.col("ret").isNotNull()).withColumns({"_r": F.row_number().over(back), "_n": F.count("*").over(Window.partitionBy("entity"))}).filter((F.col("_r") <= lookback) & (F.col("_n") >= minimum))
    d = drawdown(r.select("entity", "date", "ret"), None).groupBy("entity").agg(F.max_by("drawdown", "date").alias("drawdown"))
    t = tails.filter((F.col("asset") == asset) & (F.col("horizon") == horizon) & (F.col("variant") == "all"))
    return d.withColumn("state", drawdown_state(F.col("drawdown"))).join(t.select("state", "n_obs", "p10", "p50", "p90", "prob_neg"), "state", "left")


# --- overnight pairs ----------------------------------------------------------------------

def overnight_pairs(prints: DataFrame, bars: DataFrame, close_from: str, close_to: str, open_from: str, open_to: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Last pre-close print, first print before the next open, and the gap that followed.

    prints (market_id, ticker, ts, p); bars (ticker, date, px_open, px_last).  Next trading
    days come from the calendar of the bars; an equity row must follow the same day.
    """
    p = prints.filter((F.col("p") > lo) & (F.col("p") < hi)).withColumns({"d": F.to_date("ts"), "tod": F.date_format("ts", "HH:mm:ss")})
    c = p.filter((F.col("tod") >= close_from) & (F.col("tod") < close_to)).groupBy("market_id", "ticker", "d").agg(F.max_by("p", "ts").alias("p_close"))
    o = p.filter((F.col("tod") >= open_from) & (F.col("tod") < open_to)).groupBy("market_id", F.col("d").alias("d_next")).agg(F.min_by("p", "ts").alias("p_open"))
    cal = bars.select(F.col("date").alias("d")).distinct().withColumn("d_next", F.lead("d").over(Window.orderBy("d"))).filter("d_next IS NOT NULL")
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars.withColumns({"prev_close": F.lag("px_last").over(w), "prev_date": F.lag("date").over(w)}).select("ticker", F.col("date").alias("d_next"), "px_open", "px_last", "prev_close", "prev_date")
    j = c.join(cal, "d").join(o, ["market_id", "d_next"]).join(b, ["ticker", "d_next"]).filter((F.col("prev_date") == F.col("d")) & F.col("px_open").isNotNull() & F.col("prev_close").isNotNull())
    return j.select("market_id", "ticker", "d", "d_next", "p_close", "p_open", (F.col("p_open") - F.col("p_close")).alias("delta_p"), F.log(F.col("px_open") / F.col("prev_close")).alias("r_gap"), F.log(F.col("px_last") / F.col("px_open")).alias("r_cont"))


def clustered_slope(df: DataFrame, y: str, x: str, fe: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope of demeaned y on demeaned x with cluster-robust error, by aggregates alone."""
    by = list(by)
    m = df.groupBy(*by, fe).agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    d = df.join(m, [*by, fe]).withColumns({"_y": F.col(y) - F.col("_my"), "_x": F.col(x) - F.col("_mx")})
    s = d.groupBy(*by).agg(F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.count("*").alias("n"))
    s = s.withColumn("gamma", ratio("_xy", "_xx"))
    sc = d.groupBy(*by, cluster).agg(F.sum(F.col("_x") * F.col("_y")).alias("_cy"), F.sum(F.col("_x") * F.col("_x")).alias("_cx"))
    j = (sc.join(s, by) if by else sc.join(s)).withColumn("_u", F.col("_cy") - F.col("gamma") * F.col("_cx"))
    g = j.groupBy(*by).agg(F.sum(F.col("_u") ** 2).alias("_meat"), F.count("*").alias("n_clusters"))
    r = s.join(g, by) if by else s.join(g)
    G, n = F.col("n_clusters"), F.col("n")
    se = F.sqrt(F.col("_meat") * G / (G - 1) * (n - 1) / (n - 1)) / F.col("_xx")
    return r.select(*by, "gamma", (F.col("gamma") / se).alias("t_stat"), (F.col("_xy") ** 2 / (F.col("_xx") * F.col("_yy"))).alias("r2"), "n", "n_clusters")


def next_night(df: DataFrame, y: str = "r_gap", by: str = "market_id", order: str = "d") -> DataFrame:
    """Placebo: tonight's change against the following night's gap."""
    return df.withColumn("next_gap", F.lead(y).over(Window.partitionBy(by).orderBy(order))).filter(F.col("next_gap").isNotNull())


def threshold_pnl(pairs: DataFrame, thetas: Sequence[float], costs: Sequence[float]) -> DataFrame:
    """Weighted ticker signal per night, traded beyond each threshold, per leg and cost; the
    ticker's own gap is read from its market with the largest id."""
    w = F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(1.0))
    a = pairs.groupBy("ticker", "d_next").agg((F.sum(F.col("delta_p") * w) / F.sum(w)).alias("delta_p"), F.max_by("r_gap", "market_id").alias("gap"), F.max_by("r_cont", "market_id").alias("continuation"))
    t = F.explode(F.array(*[F.lit(float(x)) for x in thetas])).alias("theta")
    s = a.select("*", t).filter(F.abs("delta_p") >= F.col("theta"))
    legs = F.explode(F.array(F.struct(F.lit("gap").alias("leg"), (F.signum("delta_p") * F.col("gap")).alias("pnl")), F.struct(F.lit("continuation").alias("leg"), (F.signum("delta_p") * F.col("continuation")).alias("pnl"))))
    d = s.withColumn("_l", legs).groupBy("theta", F.col("_l.leg").alias("leg"), "d_next").agg(F.avg("_l.pnl").alias("pnl"), F.count("*").alias("n"))
    c = F.explode(F.array(*[F.lit(float(x)) for x in costs])).alias("cost_bps")
    d = d.select("*", c).withColumn("net", F.col("pnl") - 2 * F.col("cost_bps") / 1e4)
    sd = F.stddev_samp("net")
    return d.groupBy("theta", "leg", "cost_bps").agg(F.count("*").alias("n_days"), F.sum("n").alias("n_trades"), (F.avg("net") * 252).alias("ann_return"), F.when(sd > 0, F.avg("net") / sd * math.sqrt(252)).alias("sharpe"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"))


# --- design diagnostics and probes --------------------------------------------------------

def gram(df: DataFrame, columns: Sequence[str], target: str, widest: int = 200) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of a design as sums; only d x d numbers reach the driver, whose
    eigen-decomposition is refused beyond ``widest`` columns, before any work."""
    d = len(columns)
    if d > widest:
        raise ValueError("the design is wider than the driver-side eigen-decomposition is meant for")
    aggs = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(d) for j in range(i, d)]
    row = df.select(*columns, target).na.drop().agg(*aggs, *[F.sum(F.col(c) * F.col(target)) for c in columns], F.sum(F.col(target) ** 2), F.count("*")).first()
    g, k = np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = row[k]
            k += 1
    return g, np.array(row[k:k + d], float), float(row[k + d]), int(row[k + d + 1])


def spectral_diagnostics(df: DataFrame, columns: Sequence[str], target: str, floor: float = 1e-6) -> DataFrame:
    """Eigenvalues, effective rank, noise-edge count and source slope of a design."""
    g, b, yy, n = gram(df, columns, target)
    lam, v = np.linalg.eigh(g)
    lam = np.clip(lam, 0, None)
    p = lam / lam.sum()
    eff = float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
    c = np.abs(v.T @ b)
    keep = lam > floor * lam.max()
    slope = float(np.polyfit(np.log(lam[keep]), np.log(np.maximum(c[keep] / lam[keep], 1e-300)), 1)[0]) if keep.sum() >= 3 else float("nan")
    edge = (lam.sum() / len(lam)) * (1 + math.sqrt(len(lam) / n)) ** 2
    regime = "learnable" if slope > 0 else ("marginal" if slope > -0.5 else "noise-limited")
    rows = [(float(lam.max()), float(lam.min()), eff, int((lam > edge).sum()), slope, regime, n)]
    return df.sparkSession.createDataFrame(rows, "lambda_max double, lambda_min double, effective_rank double, n_above_edge int, source_slope double, regime string, n_obs long")


def dominance(df: DataFrame, key: str, value: str, limit: float = 0.5) -> DataFrame:
    """Share of the total absolute contribution per group and the group that dominates."""
    c = df.groupBy(key).agg(F.sum(value).alias("contribution"))
    t = c.agg(F.sum(F.abs("contribution")).alias("_t"))
    return c.join(t).select(key, "contribution", ratio(F.abs("contribution"), "_t").alias("share"), (ratio(F.abs("contribution"), "_t") > limit).alias("dominates"))


def leave_one_window_out(ic: DataFrame, windows: Sequence[tuple[str, str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Mean IC without each named window, and its ratio to the full mean, for each group ``by``."""
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in windows])
    d = ic.withColumn("_w", F.explode(rows)).withColumn("_in", F.col("date").between(F.col("_w.a"), F.col("_w.b")))
    g = d.groupBy(*by, F.col("_w.n").alias("window")).agg(F.avg("ic").alias("full_ic"), F.avg(F.when(~F.col("_in"), F.col("ic"))).alias("without"))
    return g.withColumn("residual", ratio("without", "full_ic")).withColumn("status", F.when(F.col("residual") < 0.5, "warning").otherwise("pass"))


def detectable_band(returns: DataFrame, horizon: int, lo: float = 0.25, hi: float = 0.55) -> DataFrame:
    """Effective sample size and detectable IC under a band of equicorrelation."""
    a = returns.agg(F.countDistinct("date").alias("n_obs"), F.countDistinct("entity").alias("n_entities"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("n_obs") / horizon))
    n = lambda rho: F.greatest(F.lit(1.0), blocks * F.col("n_entities") / (1 + (F.col("n_entities") - 1) * rho))
    return a.select("n_obs", "n_entities", F.round(n(hi)).alias("effective_n_lo"), F.round(n(lo)).alias("effective_n_hi"), F.round(2.8 / F.sqrt(n(lo)), 3).alias("detectable_ic_lo"), F.round(2.8 / F.sqrt(n(hi)), 3).alias("detectable_ic_hi"))


def attach_analog_outcomes(members: DataFrame, returns: DataFrame, horizons: Sequence[int], entity: str = "entity") -> DataFrame:
    """Forward returns after each analog date (by row), and their difference to the whole
    sample's mean over the same horizon."""
    w = Window.partitionBy(entity).orderBy("date")
    cols = [F.struct(F.lit(h).alias("horizon"), F.when(F.count("ret").over(w.rowsBetween(1, h)) == h, F.expm1(F.sum(F.log1p("ret")).over(w.rowsBetween(1, h)))).alias("fwd")) for h in horizons]
    f = returns.withColumn("_a", F.array(*cols)).withColumn("_f", F.explode("_a")).select(entity, "date", "_f.horizon", "_f.fwd")
    base = f.groupBy(entity, "horizon").agg(F.avg("fwd").alias("base"))
    return members.join(f, [entity, "date"]).join(base, [entity, "horizon"]).withColumn("excess", F.col("fwd") - F.col("base"))


def trim_thin_months(df: DataFrame, minimum: int) -> DataFrame:
    """Cut the panel after its last month with enough entities."""
    n = df.filter(F.col("ret").isNotNull()).groupBy("date").agg(F.countDistinct("entity").alias("_n")).filter(F.col("_n") >= minimum)
    return df.join(n.agg(F.max("date").alias("_last"))).filter(F.col("date") <= F.col("_last")).drop("_last")


def episode_backtest(impulse: DataFrame, episodes: Sequence[tuple[str, str, str, str]], window: int = 36, minimum: int = 24) -> DataFrame:
    """Extreme impulse z inside known episodes (name, entity, start, end)."""
    from ..operators.normalise import rolling_z

    z = rolling_z(impulse, window, minimum, ("entity",), ddof=1)
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(e).alias("e"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, e, a, b in episodes])
    d = z.withColumn("_e", F.explode(rows)).filter((F.col("entity") == F.col("_e.e")) & F.col("date").between(F.col("_e.a"), F.col("_e.b")))
    return d.groupBy(F.col("_e.n").alias("episode"), "entity").agg(F.max(F.abs("z")).alias("peak_abs_z"), F.max_by("z", F.abs("z")).alias("z_at_peak"), F.max_by("date", F.abs("z")).alias("peak_date"))
