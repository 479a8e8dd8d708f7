"""Neighbour features over weighted directed edges (src = focal, dst = neighbour)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import month_start
from ..functions.ranks import positions
from ..session import settle
from .features import drawdown, on_calendar, trailing_return
from .joins import interval_months


def neighbour_mean(
    metric: DataFrame, edges: DataFrame, value: str = "value", extra: Sequence[str] = (), out: str = "nbr"
) -> DataFrame:
    """Weighted mean of the neighbours' values per (focal, date); weights are renormalised
    over the neighbours that have a value that date.

    ``extra`` are further equality keys present on both sides (an edge type, a vintage).
    The weighted sums combine map-side right after the join.
    """
    m = metric.filter(F.col(value).isNotNull()).select(F.col("entity").alias("dst"), "date", F.col(value).alias("_x"), *extra)
    e = edges.filter((F.col("src") != F.col("dst")) & F.col("weight").isNotNull())
    return (
        m.join(e, ["dst", *extra])
        .groupBy("src", "date", *extra)
        .agg((F.sum(F.col("weight") * F.col("_x"))).alias("_s"), F.sum("weight").alias("_w"))
        .filter(F.col("_w") > 1e-12)
        .select(F.col("src").alias("entity"), "date", *extra, (F.col("_s") / F.col("_w")).alias(out))
    )


def neighbour_gap(metric: DataFrame, edges: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Neighbour mean minus the entity's own value."""
    own = metric.filter(F.col(value).isNotNull()).select("entity", "date", F.col(value).alias("_own"))
    return neighbour_mean(metric, edges, value).join(own, ["entity", "date"]).select(
        "date", "entity", (F.col("nbr") - F.col("_own")).alias("value"), F.lit(name).alias("variable")
    )


def row_normalised(edges: DataFrame) -> DataFrame:
    e = edges.filter((F.col("src") != F.col("dst")) & (F.col("weight") > 0)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    tot = e.groupBy("src").agg(F.sum("weight").alias("_t"))
    return e.join(tot, "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("weight"))


def two_hop_edges(edges: DataFrame) -> DataFrame:
    """Square of the row-normalised weights without its diagonal."""
    w = row_normalised(edges)
    b = w.select(F.col("src").alias("dst"), F.col("dst").alias("_d"), F.col("weight").alias("_w"))
    return (
        w.join(b, "dst")
        .groupBy("src", F.col("_d").alias("dst"))
        .agg(F.sum(F.col("weight") * F.col("_w")).alias("weight"))
        .filter(F.col("src") != F.col("dst"))
    )


def two_hop_mean(metric: DataFrame, edges: DataFrame, value: str = "value", out: str = "nbr") -> DataFrame:
    """Two-hop neighbour mean without forming two-hop edges.

    The squared matrix is applied as two propagation steps, to the values and to their
    presence; the diagonal it must not have is the sum over reciprocal edges and is taken off
    at the end.  The work grows with edges x dates even where a hub joins everybody.
    """
    w = row_normalised(edges)
    base = _presence(metric, value)
    return _off_diagonal(_propagated(_propagated(base, w), w), two_walks(w), base, out)


def _presence(metric: DataFrame, value: str) -> DataFrame:
    return metric.filter(F.col(value).isNotNull()).select("entity", "date", F.col(value).alias("_x"), F.lit(1.0).alias("_n"))


def _propagated(d: DataFrame, w: DataFrame) -> DataFrame:
    """One application of the weights to values and presence; the sums combine map-side."""
    return (
        d.withColumnRenamed("entity", "dst").join(w, "dst")
        .groupBy(F.col("src").alias("entity"), "date")
        .agg(F.sum(F.col("weight") * F.col("_x")).alias("_x"), F.sum(F.col("weight") * F.col("_n")).alias("_n"))
    )


def _off_diagonal(sums: DataFrame, loops: DataFrame, base: DataFrame, out: str) -> DataFrame:
    """Weighted mean from sums that hold the entity itself with the weight ``_l`` of loops."""
    own = base.select("entity", "date", F.col("_x").alias("_o"))
    j = sums.join(loops, "entity", "left").join(own, ["entity", "date"], "left")
    # the entity's own value entered only where it has one that date
    l = F.when(F.col("_o").isNotNull(), F.coalesce("_l", F.lit(0.0))).otherwise(0.0)
    num, den = F.col("_x") - l * F.coalesce("_o", F.lit(0.0)), F.col("_n") - l
    return j.filter(den > 1e-12).select("entity", "date", (num / den).alias(out))


def two_walks(w: DataFrame) -> DataFrame:
    """Per entity the weight of its walks of two steps back to itself: reciprocal edges."""
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("_b"))
    return w.join(back, ["src", "dst"]).groupBy(F.col("src").alias("entity")).agg(F.sum(F.col("weight") * F.col("_b")).alias("_l"))


def three_walks(w: DataFrame) -> DataFrame:
    """Per entity the weight of its walks of three steps back to itself: directed triangles.

    A triangle is put together at its corner of the smallest (degree, name), from an edge in
    and an edge out whose other ends are larger, and closed by an equi join on the third
    edge.  So a hub pairs only with larger hubs, and the wedges number at most edges ** 1.5.
    """
    ends = w.select(F.col("src").alias("node")).unionByName(w.select(F.col("dst").alias("node")))
    degree = settle(ends.groupBy("node").count())
    order = [degree.select(F.col("node").alias(c), F.struct("count", "node").alias(f"_{c}")) for c in ("src", "dst")]
    e = settle(w.join(order[0], "src").join(order[1], "dst"))
    into = e.filter("_dst < _src").select(F.col("dst").alias("v"), F.col("src").alias("u"), F.col("weight").alias("_a"))
    away = e.filter("_src < _dst").select(F.col("src").alias("v"), F.col("dst").alias("x"), F.col("weight").alias("_b"))
    wedges = into.join(away, "v").filter("u <> x")
    close = w.select(F.col("src").alias("x"), F.col("dst").alias("u"), F.col("weight").alias("_c"))
    cycles = wedges.join(close, ["x", "u"]).select(F.explode(F.array("u", "v", "x")).alias("entity"), (F.col("_a") * F.col("_b") * F.col("_c")).alias("_l"))
    return cycles.groupBy("entity").agg(F.sum("_l").alias("_l"))


def katz_mean(metric: DataFrame, edges: DataFrame, alpha: float = 0.5, hops: int = 3, value: str = "value", out: str = "nbr") -> DataFrame:
    """Mean over the weights of ``katz_edges`` without forming them; ``hops`` is 1, 2 or 3.

    The truncated series is applied as ``hops`` propagation steps, to the values and to their
    presence, so the work grows with edges x dates and no matrix power fills up.  Its
    diagonal is the weight of the walks that return after two and three steps.
    """
    if hops not in (1, 2, 3):
        raise ValueError("katz_mean: hops must be 1, 2 or 3")
    w = settle(row_normalised(edges))
    base = settle(_presence(metric, value))
    step = w.withColumn("weight", F.col("weight") * alpha)
    power, total = base, None
    for _ in range(hops):
        power = settle(_propagated(power, step))
        total = power if total is None else total.unionByName(power)
    sums = total.groupBy("entity", "date").agg(F.sum("_x").alias("_x"), F.sum("_n").alias("_n"))
    walks = [f(step) for f in (two_walks, three_walks)[: hops - 1]]
    loops = walks[0] if walks else two_walks(step).limit(0)
    for more in walks[1:]:
        loops = loops.unionByName(more)
    return _off_diagonal(sums, loops.groupBy("entity").agg(F.sum("_l").alias("_l")), base, out)


def katz_edges(edges: DataFrame, alpha: float = 0.5, hops: int = 3) -> DataFrame:
    """Sum over k = 1..hops of (alpha W)^k, diagonal removed; ``hops`` is a small constant."""
    w = row_normalised(edges).withColumn("weight", F.col("weight") * alpha)
    step = w.select(F.col("src").alias("dst"), F.col("dst").alias("_d"), F.col("weight").alias("_w"))
    power, total = w, w
    for _ in range(hops - 1):
        power = settle(
            power.join(step, "dst").groupBy("src", F.col("_d").alias("dst")).agg(F.sum(F.col("weight") * F.col("_w")).alias("weight"))
        )
        total = total.unionByName(power)
    return total.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, most: int = 100, settle_every: int = 5) -> DataFrame:
    """Weighted PageRank by power iteration; the mass of nodes without out-edges is spread
    evenly.  Ends when a round moves less than ``tolerance`` per node in total; raises if
    ``most`` rounds do not get there.  Lineage is cut, and the change measured, every few
    rounds."""
    w = settle(row_normalised(edges))
    nodes = settle(w.select(F.col("src").alias("node")).unionByName(w.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    sinks = nodes.join(w.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("_sink", F.lit(True))
    nodes = settle(nodes.join(sinks, "node", "left").withColumn("_sink", F.coalesce("_sink", F.lit(False))))
    rank = nodes.withColumns({"rank": F.lit(1.0 / n), "_was": F.lit(1.0 / n)})
    for i in range(most):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("_sink"), F.col("rank"))), F.lit(0.0)).alias("_lost"))
        flow = (
            w.join(rank.select(F.col("node").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("weight") * F.col("rank")).alias("_in"))
        )
        rank = (
            rank.select("node", "_sink", F.col("rank").alias("_was")).join(flow, "node", "left").join(lost)
            .withColumn("rank", (1 - damping) / n + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / n))
            .select("node", "_sink", "rank", "_was")
        )
        if (i + 1) % settle_every == 0 or i + 1 == most:
            rank = settle(rank)
            if rank.agg(F.sum(F.abs(F.col("rank") - F.col("_was")))).first()[0] < tolerance * n:
                return rank.select("node", "rank")
    raise RuntimeError(f"pagerank: not within {tolerance} per node after {most} rounds")


def hub_scaled_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Row-normalised weights multiplied by the neighbour's rank."""
    return row_normalised(edges).join(ranks.withColumnRenamed("node", "dst"), "dst").select(
        "src", "dst", (F.col("weight") * F.col("rank")).alias("weight")
    ).filter(F.col("weight") > 0)


def blocs(edges: DataFrame, k: int = 5, iterations: int = 20) -> DataFrame:
    """(node, bloc) by power-iteration clustering of the symmetrised, normalised graph."""
    from pyspark.ml.clustering import PowerIterationClustering

    w = row_normalised(edges)
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    sym = w.select(lo.alias("a"), hi.alias("b"), "weight").groupBy("a", "b").agg((F.sum("weight") / 2).alias("weight"))
    # node numbers are hashes of the names, so they do not depend on the partitioning
    names = sym.select(F.col("a").alias("node")).unionByName(sym.select(F.col("b").alias("node"))).distinct()
    ids = settle(names.withColumn("id", F.xxhash64("node")))
    e = (
        sym.join(ids.select(F.col("node").alias("a"), F.col("id").alias("src")), "a")
        .join(ids.select(F.col("node").alias("b"), F.col("id").alias("dst")), "b")
        .select("src", "dst", "weight")
    )
    pic = PowerIterationClustering(k=k, maxIter=iterations, weightCol="weight", initMode="degree")
    return pic.assignClusters(e).join(ids, "id").select("node", F.col("cluster").cast("long").alias("bloc"))


def bloc_mean(metric: DataFrame, members: DataFrame, value: str = "value", out: str = "nbr") -> DataFrame:
    """Mean of the other members of an entity's bloc per date: sums, not mate pairs."""
    m = metric.filter(F.col(value).isNotNull()).join(members.withColumnRenamed("node", "entity"), "entity")
    s = m.groupBy("bloc", "date").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    return m.join(s, ["bloc", "date"]).filter(F.col("_c") > 1).select(
        "entity", "date", ((F.col("_s") - F.col(value)) / (F.col("_c") - 1)).alias(out)
    )


def metrics_from_returns(returns: DataFrame, fill: int = 5) -> dict[str, DataFrame]:
    """21- and 63-row returns, drawdown and deep-drawdown flag on the common calendar."""

    returns = settle(returns)

    def on_cal(d: DataFrame, c: str) -> DataFrame:
        return on_calendar(d.select("date", "entity", F.col(c).alias("value")), fill, ["entity"], ["value"])

    dd = drawdown(returns, 252)
    return {
        "ret21": on_cal(trailing_return(returns, 21), "trailing"),
        "ret63": on_cal(trailing_return(returns, 63), "trailing"),
        "drawdown": on_cal(dd, "drawdown"),
        "deep": on_cal(dd.withColumn("deep", (F.col("drawdown") <= -0.10).cast("double")), "deep"),
    }


# Features of one weight regime: name -> (edge set, metric, own value taken off).
FEATURES = {
    "TRADE_NBR_GAP_21": ("trade", "ret21", True),
    "TRADE_NBR_GAP_63": ("trade", "ret63", True),
    "BANK_NBR_GAP_21": ("bank", "ret21", True),
    "BANK_NBR_GAP_63": ("bank", "ret63", True),
    "HOLDER_STRESS": ("holder", "drawdown", False),
    "NBR_DRAWDOWN_COUNT": ("trade", "deep", False),
}


def network_features(metrics: dict[str, DataFrame], trade: DataFrame, bank: DataFrame, holder: DataFrame) -> DataFrame:
    """The seven neighbour features of one weight regime in tidy form.

    All one-hop features are one join and one aggregate: metrics and edges are long, and an
    edge row carries the feature it serves.
    """
    m = None
    for name, d in metrics.items():
        p = d.filter(F.col("value").isNotNull()).select("entity", "date", F.lit(name).alias("metric"), "value")
        m = p if m is None else m.unionByName(p)
    m, trade = settle(m), settle(trade)
    e = None
    for kind, d in (("trade", trade), ("bank", bank), ("holder", holder)):
        served = [F.struct(F.lit(f).alias("feature"), F.lit(x).alias("metric")) for f, (k, x, _) in FEATURES.items() if k == kind]
        p = d.filter((F.col("src") != F.col("dst")) & F.col("weight").isNotNull()).withColumn("_f", F.explode(F.array(*served)))
        p = p.select("src", "dst", "weight", "_f.feature", "_f.metric")
        e = p if e is None else e.unionByName(p)
    nbr = (
        m.withColumnRenamed("entity", "dst").join(e, ["dst", "metric"])
        .groupBy("src", "date", "metric", "feature")
        .agg(F.sum(F.col("weight") * F.col("value")).alias("_s"), F.sum("weight").alias("_w"))
        .filter(F.col("_w") > 1e-12)
    )
    gaps = [f for f, (_, _, gap) in FEATURES.items() if gap]
    own = m.select(F.col("entity").alias("src"), "date", "metric", F.col("value").alias("_own"))
    value = F.col("_s") / F.col("_w") - F.when(F.col("feature").isin(*gaps), F.col("_own")).otherwise(0.0)
    one = nbr.join(own, ["src", "date", "metric"], "left").select(
        "date", F.col("src").alias("entity"), value.alias("value"), F.col("feature").alias("variable")
    )
    ret21 = m.filter("metric = 'ret21'").drop("metric")
    two = two_hop_mean(ret21, trade).join(ret21.withColumnRenamed("value", "_own"), ["entity", "date"]).select(
        "date", "entity", (F.col("nbr") - F.col("_own")).alias("value"), F.lit("TWOHOP_TRADE_GAP_21").alias("variable")
    )
    return one.unionByName(two).filter(F.col("value").isNotNull())


def vintage_neighbour_mean(
    metric: DataFrame, edges: DataFrame, start: str = "applies_from", value: str = "value", out: str = "nbr"
) -> DataFrame:
    """Neighbour mean with the edge vintage whose interval holds the date (point in time)."""
    v = edges.select(start).distinct()
    dated = interval_months(metric, v, [], start).withColumnRenamed(start, "_v")
    e = edges.withColumnRenamed(start, "_v")
    return neighbour_mean(dated, e, value, ["_v"], out).drop("_v")


def build_edges(flows: DataFrame, minimum: float, edge_type: str, date: str = "snapshot") -> DataFrame:
    """Edges of each source's latest snapshot above a weight threshold."""
    last = flows.groupBy("src").agg(F.max(date).alias(date))
    return (
        flows.join(last, ["src", date])
        .filter((F.col("weight") > minimum) & (F.col("src") != F.col("dst")))
        .select("src", "dst", "weight", date, F.lit(edge_type).alias("edge_type"))
    )


def month_edge_snapshot(stored: DataFrame, current: DataFrame, month: str) -> DataFrame:
    """Current edges as the snapshot of ``month``; other months stay as stored."""
    kept = stored.filter(F.col("snapshot_month") != month)
    return kept.unionByName(current.withColumn("snapshot_month", F.lit(month)).select(*stored.columns))


def ranked_discoveries(df: DataFrame, theme: str = "theme", score: str = "score", key: str = "entity") -> DataFrame:
    """Rank inside each theme by absolute score, ties by key, and the absolute score for an
    order across themes; NULL scores come last.  A theme may have any size."""
    d = df.withColumns({"abs_score": F.abs(score), "_rank_by": F.coalesce(F.abs(score), F.lit(-1))})
    d = positions(d, [theme], "_rank_by", [key], descending=True, out="rank_in_theme", total="_theme_n")
    return d.withColumn("rank_in_theme", F.col("rank_in_theme").cast("long")).drop("_rank_by", "_theme_n")
