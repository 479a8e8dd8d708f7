"""Prediction-market snapshots: quality flags, aggregation, composites, scoring."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import clip, ratio
from ..functions.ranks import group_quantiles
from .joins import asof

# Signal names that must always be present, and confidence multipliers.
REQUIRED_GLOBAL = (
    "fed_cut_count_expectation", "fed_decision_distribution_next", "cpi_nowcast_yoy_next", "cpi_nowcast_core_next", "unemployment_nowcast_next",
    "recession_prob_12m", "oil_shock_prob_30d", "hormuz_disruption_prob_90d", "regional_conflict_premium_middle_east",
    "regional_conflict_premium_pacific", "regional_conflict_premium_eastern_europe",
)
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.75, "low": 0.5}
DEFAULT_CONFIDENCE = 0.6


def quality_flags(df: DataFrame, min_flow: float = 500.0, hours: int = 24) -> DataFrame:
    """Stale and effectively-settled flags of outcome rows at their snapshot time."""
    live = F.coalesce((F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & (F.col("ask") - F.col("bid") <= 0.05), F.lit(False))
    no_flow = F.coalesce("volume_24h", F.lit(0.0)) < min_flow
    old = F.coalesce(F.col("last_trade_ts") < F.col("snapshot_ts") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))
    gap = F.coalesce(F.abs(F.col("last_price") - F.col("probability")) > 0.05, F.lit(False))
    rail = F.coalesce((F.col("probability") >= 0.99) | (F.col("probability") <= 0.01), F.lit(False))
    return df.withColumns({
        "is_stale": (~live & (no_flow | old)) | gap,
        "is_settled": rail & (F.col("ask").isNull() | F.col("bid").isNull()),
    })


SPILLOVER = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("country", T.StringType()), ("elasticity", T.DoubleType()), ("channel", T.StringType()), ("confidence", T.StringType()))]))


def spillover_rows(markets: DataFrame, payload: str = "spillovers") -> DataFrame:
    """Nested spillover lists -> one row per (market, entity)."""
    d = markets.withColumn("_s", F.explode(F.from_json(payload, SPILLOVER)))
    return d.select(
        "market_id", F.col("_s.country").alias("entity"), F.coalesce("_s.elasticity", F.lit(0.0)).alias("elasticity"), F.col("_s.channel").alias("channel"),
        F.lower(F.coalesce("_s.confidence", F.lit("medium"))).alias("confidence"))


def primary_outcome(df: DataFrame, drop_settled: bool = False) -> DataFrame:
    """One outcome per market: 'yes' first, then sort order, then the higher probability."""
    d = df.filter(~F.coalesce("is_settled", F.lit(False))) if drop_settled else df
    w = Window.partitionBy("market_id").orderBy(
        (F.lower(F.coalesce("label", F.lit(""))) == "yes").desc(), F.coalesce("sort_order", F.lit(999)), F.col("probability").desc_nulls_last(), "outcome_id")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def flow_weight() -> Column:
    """Liquidity where positive, else volume, never negative."""
    liq = F.greatest(F.coalesce("liquidity", F.lit(0.0)), F.lit(0.0))
    return F.when(liq > 0, liq).otherwise(F.greatest(F.coalesce("volume_24h", F.lit(0.0)), F.lit(0.0)))


def weighted_probability(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Liquidity-weighted probability over the active (not stale) rows."""
    d = df.filter(~F.coalesce("is_stale", F.lit(True))).withColumn("_w", flow_weight()).filter("_w > 0")
    return d.groupBy(*by).agg(
        (F.sum(F.col("probability") * F.col("_w")) / F.sum("_w")).alias("value"), F.count("*").alias("n_markets"), F.sum("_w").alias("total_weight"))


def outcome_midpoint() -> Column:
    """Middle of the thresholds, else the mean of the first two numbers of the label."""
    nums = F.transform(F.regexp_extract_all("label", F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    both = F.col("threshold_low").isNotNull() & F.col("threshold_high").isNotNull()
    return F.when(both, (F.col("threshold_low") + F.col("threshold_high")) / 2).when(F.size(nums) == 1, nums[0]).when(F.size(nums) >= 2, (F.try_element_at(nums, F.lit(1)) + F.try_element_at(nums, F.lit(2))) / 2)


def expected_value(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected outcome of bucketed distributions: per market, then weighted over markets."""
    d = df.filter(~F.coalesce("is_stale", F.lit(True))).withColumns({"_m": outcome_midpoint(), "_w": flow_weight()})
    d = d.filter(F.col("_m").isNotNull() & F.col("probability").isNotNull() & (F.col("_w") > 0))
    m = d.groupBy(*by, "market_id").agg(F.sum(F.col("_m") * F.col("probability")).alias("_e"), F.max("_w").alias("_w"))
    return m.groupBy(*by).agg((F.sum(F.col("_e") * F.col("_w")) / F.sum("_w")).alias("value"), F.count("*").alias("n_markets"), F.sum("_w").alias("total_weight"))


def category_confidence(resolutions: DataFrame) -> DataFrame:
    """1 - Brier per category, bounded to [0.1, 1]; (category, p_before, resolution)."""
    b = F.avg((F.coalesce("p_before", F.lit(0.5)) - F.col("resolution")) ** 2)
    return resolutions.filter(F.col("resolution").isNotNull()).groupBy("category").agg(b.alias("brier")).withColumn("confidence", clip(1 - F.col("brier"), 0.1, 1.0))


def global_composites(outcomes: DataFrame, rules: Sequence[tuple[str, str, str, str]], confidence: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Named signals by rule (name, category regex, subcategory regex, kind).

    ``kind`` 'expectation' uses the distribution and falls back to the weighted probability of
    the primary outcomes; 'probability' uses the latter.  Settled rows are excluded; required
    names without data appear as empty placeholders.
    """
    spec = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("name", "cat", "sub", "kind"), r)]) for r in rules])
    live = outcomes.filter(~F.coalesce("is_settled", F.lit(False)))

    def matched(d: DataFrame) -> DataFrame:
        m = d.withColumn("_r", F.explode(F.filter(spec, lambda r: F.rlike("category", r["cat"]) & F.rlike(F.coalesce("subcategory", F.lit("")), r["sub"]))))
        return m.withColumns({"signal": F.col("_r.name"), "_kind": F.col("_r.kind")})

    e = expected_value(matched(outcomes).filter("_kind = 'expectation'"), ["signal"])
    p = weighted_probability(matched(primary_outcome(live)), ["signal"])
    both = e.select("signal", F.lit(1).alias("_o"), "value", "n_markets", "total_weight").unionByName(p.select("signal", F.lit(2).alias("_o"), "value", "n_markets", "total_weight"))
    best = both.groupBy("signal").agg(F.min_by(F.struct("value", "n_markets", "total_weight"), "_o").alias("_b")).select("signal", "_b.*")
    cats = matched(live).select("signal", "category").distinct().join(confidence.select("category", "confidence"), "category", "left")
    conf = cats.groupBy("signal").agg(F.avg(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("confidence"))
    out = best.join(conf, "signal", "left")
    if required:
        names = outcomes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in sorted(set(required) | {r[0] for r in rules})])).alias("signal"))
        out = names.join(out, "signal", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_markets", "total_weight", "confidence")})
    return out


def entity_composites(primary: DataFrame, spill: DataFrame, tariff: str = "tariff|trade_war", resolved: str = "agreement|resolution") -> DataFrame:
    """Per entity: tariff intensity, downside risk and opportunity from spillovers."""
    cm = F.create_map(*[x for k, v in CONFIDENCE_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    j = spill.join(primary.filter(F.col("probability").isNotNull()), "market_id").withColumns({"_w": flow_weight(), "_c": F.coalesce(cm[F.col("confidence")], F.lit(0.75)), "_stale": F.coalesce("is_stale", F.lit(True))})
    t = j.filter(F.col("category").rlike(tariff)).withColumn("_tw", F.col("_w") * F.col("_c") * F.when(F.col("_stale"), 0.25).otherwise(1.0)).filter("_tw > 0")
    prob = clip(F.when(F.lower(F.coalesce("subcategory", F.lit(""))).rlike(resolved), 1 - F.col("probability")).otherwise(F.col("probability")), 0, 1)
    tar = t.groupBy("entity").agg((F.sum(prob * F.col("_tw")) / F.sum("_tw")).alias("value"), F.countDistinct("market_id").alias("n_markets"), F.sum("_tw").alias("total_weight")).withColumn("signal", F.lit("tariff_intensity"))
    e = j.withColumn("_ew", F.when(F.col("_stale"), 0.0).otherwise(F.col("_w") * F.col("_c"))).filter("_ew > 0")
    opp = e.groupBy("entity").agg((F.sum(F.col("probability") * F.col("elasticity") * F.col("_ew")) / F.sum("_ew")).alias("value"), F.countDistinct("market_id").alias("n_markets"), F.sum("_ew").alias("total_weight")).withColumn("signal", F.lit("opportunity"))
    risk = opp.withColumns({"value": -F.col("value"), "signal": F.lit("risk")})
    return tar.unionByName(opp).unionByName(risk)


def resolution_rows(resolved: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Probability last seen 24 h and 1 h before resolution, else the current one.

    resolved (market_id, resolved_ts, probability, resolution); snapshots (market_id, ts, p)."""
    d = resolved
    for h in (24, 1):
        left = d.withColumn("_at", F.col("resolved_ts") - F.expr(f"INTERVAL {h} HOURS"))
        d = asof(left, snapshots.select("market_id", F.col("ts").alias("_at"), F.col("p").alias(f"_p{h}")), ["market_id"], [f"_p{h}"], "_at").drop("_at", "asof__at")
    return d.select("market_id", "resolved_ts", "resolution", F.coalesce("_p24", "probability").alias("p_24h"), F.coalesce("_p1", "probability").alias("p_1h"))


# --- forecast scoring ---------------------------------------------------------------------

def score_forecasts(df: DataFrame, by: Sequence[str] = ("model", "arm", "market_id", "horizon")) -> DataFrame:
    """Repeats reduced to their median; Brier and log loss of forecast and market."""
    by = list(by)
    g = df.groupBy(*by).agg(F.count("*").alias("n_samples"), F.max("p_mkt").alias("p_mkt"), F.max("outcome").alias("outcome"))
    g = g.join(group_quantiles(df, by, "p", {"p_fc": 0.5}), by)
    o = F.col("outcome")

    def logloss(c: str) -> Column:
        p = clip(c, 1e-6, 1 - 1e-6)
        return -(o * F.log(p) + (1 - o) * F.log(1 - p))

    return g.withColumns({"brier": (F.col("p_fc") - o) ** 2, "brier_mkt": (F.col("p_mkt") - o) ** 2, "logloss": logloss("p_fc"), "logloss_mkt": logloss("p_mkt")}).withColumn("edge", F.col("brier_mkt") - F.col("brier"))


def score_resolved(forecasts: DataFrame, outcomes: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live scoring: forecasts whose outcome is known and that are not stored yet."""
    s = score_forecasts(forecasts.drop("outcome").join(outcomes.select("market_id", "outcome"), "market_id"), keys)
    return s.join(stored.select(*keys), list(keys), "left_anti")


def trade_rule(df: DataFrame, thetas: Sequence[float], costs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One unit on the forecast's side whenever it is more than theta from the market."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(c)).alias("c")) for t in thetas for c in costs]))
    d = df.withColumn("_g", grid).withColumns({"theta": F.col("_g.t"), "cost": F.col("_g.c")})
    o, m, p = F.col("outcome"), F.col("p_mkt"), F.col("p_fc")
    pnl = F.when(p > m + F.col("theta"), o - (m + F.col("cost"))).when(p < m - F.col("theta"), (1 - o) - ((1 - m) + F.col("cost")))
    d = d.withColumn("pnl", pnl).filter(F.col("pnl").isNotNull())
    s = F.stddev_samp("pnl")
    return d.groupBy(*by, "theta", "cost").agg(
        F.count("*").alias("n_trades"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("total_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.min("pnl").alias("worst"),
        F.when((F.count("*") > 2) & (s > 0), F.avg("pnl") / (s / F.sqrt(F.count("*").cast("double")))).alias("t_stat"))


def calibration_slices(df: DataFrame, slices: Sequence[str], hit: str = "outcome", score: str = "brier", ret: str | None = None) -> DataFrame:
    """n, hit rate and mean score per value of each slice column, all slices in one pass."""
    aggs = [F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), F.avg(score).alias("brier")] + ([F.avg(ret).alias("avg_return")] if ret else [])
    d = df.groupingSets([[F.col(s)] for s in slices], *[F.col(s) for s in slices]).agg(*aggs, F.grouping_id().alias("_g"))
    # grouping_id has a 1 for every column that is rolled up: the 0 bit names the slice
    k = len(slices)
    name, val = None, None
    for i, s in enumerate(slices):
        is_s = F.col("_g").bitwiseAND(1 << (k - 1 - i)) == 0
        name = F.when(is_s, s) if name is None else name.when(is_s, s)
        val = F.when(is_s, F.col(s).cast("string")) if val is None else val.when(is_s, F.col(s).cast("string"))
    return d.select(name.alias("slice"), val.alias("slice_value"), *[c for c in ("n", "hit_rate", "brier", "avg_return") if c in d.columns])


def calibration_curve(df: DataFrame, edges: Sequence[float], p: str = "p_fc", hit: str = "outcome") -> DataFrame:
    """Stated against realised frequency per probability bucket [lo, hi)."""
    b = None
    for lo, hi in zip(edges, edges[1:]):
        c, label = (F.col(p) >= lo) & (F.col(p) < hi), f"[{lo:.2f}, {hi:.2f})"
        b = F.when(c, label) if b is None else b.when(c, label)
    return df.withColumn("bucket", b).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(hit).alias("realised"), F.avg(p).alias("stated"))
