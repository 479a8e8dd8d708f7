"""Factor portfolios: soft-band weights, net returns, attribution, cost-aware evaluation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import before, clip, series, so_far
from ..functions.ranks import positions
from ..session import settle
from .joins import numbered, with_boundaries_passed

# Full weight below the first rank fraction, none above the second.
BAND_TOP, BAND_CUTOFF = 0.15, 0.25


def band_weight(rank_pct: Column) -> Column:
    taper = 1 - (rank_pct - BAND_TOP) / (BAND_CUTOFF - BAND_TOP)
    return (
        F.when(rank_pct < BAND_TOP, F.lit(1.0))
        .when(rank_pct <= BAND_CUTOFF, taper)
        .otherwise(F.lit(0.0))
    )


def band_total(n: Column) -> Column:
    """Sum of the band weights of positions 1..n; it depends on n alone."""

    def count_up_to(edge: float, strict: bool) -> Column:
        def inside(i: Column) -> Column:
            return (i / n < edge) if strict else (i / n <= edge)

        c = F.floor(n * edge)
        return F.when(inside(c + 1), c + 1).when(inside(c), c).otherwise(c - 1)

    full, last = count_up_to(BAND_TOP, True), count_up_to(BAND_CUTOFF, False)
    width = BAND_CUTOFF - BAND_TOP
    edge = (last - full) * (1 + BAND_TOP / width) - (full + 1 + last) * (last - full) / 2 / n / width
    return full + edge


def soft_band_weights(
    df: DataFrame,
    by: Sequence[str] = ("variable", "date"),
    value: str = "value",
    tie: Sequence[str] = ("entity",),
    out: str = "weight",
) -> DataFrame:
    """Long weights of the best fifth with a linear edge, summing to 1 per group.

    Every factor and date goes through one ranking pass; entities with no weight are dropped.
    """
    by = list(by)
    return (
        positions(df, by, value, tie, descending=True, out="_pos", total="_n")
        .withColumn("_w", band_weight(F.col("_pos") / F.col("_n")))
        .filter(F.col("_w") > 0)
        .withColumn(out, F.col("_w") / band_total(F.col("_n")))
        .drop("_pos", "_n", "_w")
    )


def portfolio_returns(
    signal: DataFrame,
    returns: DataFrame,
    benchmark: DataFrame | None = None,
    by: Sequence[str] = ("variable", "date"),
    value: str = "value",
    ret: str = "ret",
) -> DataFrame:
    """sum(weight * return) - benchmark per factor and date.

    Ranking uses only entities with both a signal and a return.  Without ``benchmark``
    (date, bench) the mean return of the date is the benchmark.
    """
    both = signal.filter(F.col(value).isNotNull()).join(
        returns.filter(F.col(ret).isNotNull()).select("date", "entity", ret), ["date", "entity"]
    )
    port = (
        soft_band_weights(both, by, value)
        .groupBy(*by)
        .agg(F.sum(F.col("weight") * F.col(ret)).alias("gross"), F.count("*").alias("held"))
    )
    bench = benchmark if benchmark is not None else returns.groupBy("date").agg(F.avg(ret).alias("bench"))
    return port.join(bench.filter(F.col("bench").isNotNull()), "date").withColumn(
        "net", F.col("gross") - F.col("bench")
    )


def next_row_returns(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Each date labelled with the return of the next date of the common calendar."""
    dates = returns.select("date").distinct()
    nxt = dates.withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    return (
        nxt.filter(F.col("_next").isNotNull())
        .join(returns.withColumnRenamed("date", "_next"), "_next")
        .drop("_next")
    )


def next_day_factor_returns(
    signal: DataFrame, returns: DataFrame, benchmark: DataFrame, value: str = "value"
) -> DataFrame:
    """Weights ranked on all signals of a date earn the next calendar row's return.

    A held entity without a return adds nothing; dates with no return at all give NULL
    gross.  Factors whose net return never moves are dropped.
    """
    w = soft_band_weights(signal, ("variable", "date"), value)
    nxt = next_row_returns(returns).select("date", "entity", "ret")
    port = (
        w.join(nxt, ["date", "entity"], "left")
        .groupBy("variable", "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
        .join(benchmark, "date")
        .withColumn("net", F.coalesce(F.col("gross") - F.col("bench"), F.lit(0.0)))
    )
    port = settle(port)  # one row per factor and date, read twice
    moving = port.groupBy("variable").agg(F.sum(F.abs("net")).alias("_a")).filter(F.col("_a") > 0)
    return port.join(moving.select("variable"), "variable", "left_semi")


def fill_with_row_mean(
    df: DataFrame, by: str = "date", name: str = "variable", value: str = "net"
) -> DataFrame:
    """Complete the (date, factor) grid; a missing return becomes the mean of its date."""
    dates = df.groupBy(by).agg(F.avg(value).alias("_m"))
    # The factor list is code-sized (one row per registered factor), the date list one row
    # per calendar day: the grid is bounded by calendar x factors.
    names = df.groupBy().agg(F.collect_set(name).alias("_names"))
    grid = dates.join(names).withColumn(name, F.explode("_names")).drop("_names")
    return (
        grid.join(df.select(by, name, value), [by, name], "left")
        .withColumn(value, F.coalesce(F.col(value), F.col("_m")))
        .drop("_m")
    )


def trailing_mean(
    df: DataFrame, n: int = 60, by: Sequence[str] = ("variable",), value: str = "net", out: str = "trailing"
) -> DataFrame:
    """Mean of the n rows before the current one (the current row is not used)."""
    w = series(by).rowsBetween(-n, -1)
    return df.withColumn(out, F.avg(value).over(w))


def contributions(membership: DataFrame, factor_returns: DataFrame) -> DataFrame:
    """Membership weights joined to factor returns; contribution = weight x return."""
    return membership.join(
        factor_returns.withColumnRenamed("value", "factor_return"), ["date", "factor", "source"]
    ).withColumn("contribution", F.col("weight") * F.col("factor_return"))


def factor_contributions(signal: DataFrame, returns: DataFrame, source: str, value: str = "value", ret: str = "ret") -> DataFrame:
    """Membership weights, net factor returns and contributions from one ranking pass."""
    both = settle(
        signal.filter(F.col(value).isNotNull()).join(returns.filter(F.col(ret).isNotNull()).select("date", "entity", ret), ["date", "entity"])
    )
    members = settle(soft_band_weights(both, ("variable", "date"), value))
    bench = returns.groupBy("date").agg(F.avg(ret).alias("_b"))
    net = (
        members.groupBy("variable", "date").agg(F.sum(F.col("weight") * F.col(ret)).alias("_g"))
        .join(bench, "date")
        .select("date", F.col("variable").alias("factor"), (F.col("_g") - F.col("_b")).alias("value"), F.lit(source).alias("source"))
    )
    m = members.select("date", "entity", F.col("variable").alias("factor"), "weight", F.lit(source).alias("source"))
    return contributions(m, net)


def attribution(contrib: DataFrame, by_magnitude: bool, n: int | None = None) -> DataFrame:
    """Summed contribution per entity and factor, ordered by sign or by magnitude."""
    tot = contrib.groupBy("entity", "factor").agg(
        F.sum("contribution").alias("contribution"), F.count("*").alias("periods")
    )
    key = F.abs("contribution") if by_magnitude else F.col("contribution")
    out = tot.orderBy(key.desc(), "entity", "factor")
    return out.limit(n) if n else out


def quantile_legs(
    df: DataFrame,
    pct: str,
    low: float,
    high: float,
    long_low: bool,
    minimum: int = 8,
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Equal-weight long and short legs (+1/n_long, -1/n_short) from a percentile column.

    Dates with fewer than ``minimum`` entities, or with an empty leg, carry no position.
    """
    by = list(by)
    d = df.filter(F.col(pct).isNotNull())
    is_low, is_high = F.col(pct) <= low, F.col(pct) >= high
    side = F.when(is_low, 1 if long_low else -1).when(is_high, -1 if long_low else 1)
    d = d.withColumn("_side", side)
    n = d.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.count(F.when(F.col("_side") == 1, 1)).alias("_l"),
        F.count(F.when(F.col("_side") == -1, 1)).alias("_s"),
    ).filter((F.col("_n") >= minimum) & (F.col("_l") > 0) & (F.col("_s") > 0))
    return (
        d.filter(F.col("_side").isNotNull())
        .join(n, by)
        .withColumn(
            "weight",
            F.when(F.col("_side") == 1, 1 / F.col("_l")).otherwise(-1 / F.col("_s")),
        )
        .drop("_side", "_n", "_l", "_s")
    )


def evaluate_weights(
    weights: DataFrame, returns: DataFrame, cost_bps: Sequence[float] = (0, 10, 25, 50), ret: str = "ret"
) -> DataFrame:
    """Per date: gross, turnover, exposures and net at each cost.

    Turnover is the summed absolute weight change against the previous dated book; a name
    absent from a book has weight 0, so each weight is compared with the book before it and
    a name that leaves is charged on the next book's date.
    """
    books = weights.select("date").distinct()
    cal = books.withColumns(
        {"_prev": F.lag("date").over(Window.orderBy("date")), "_next": F.lead("date").over(Window.orderBy("date"))}
    )
    w = weights.select("date", "entity", "weight").join(cal, "date")
    prev = Window.partitionBy("entity").orderBy("date")
    w = w.withColumns(
        {
            "_before": F.when(F.lag("date").over(prev).eqNullSafe(F.col("_prev")), F.lag("weight").over(prev)),
            "_stays": F.lead("date").over(prev).eqNullSafe(F.col("_next")),
        }
    )
    changes = w.select("date", F.abs(F.col("weight") - F.coalesce("_before", F.lit(0.0))).alias("chg")).unionByName(
        w.filter(~F.col("_stays") & F.col("_next").isNotNull()).select(
            F.col("_next").alias("date"), F.abs("weight").alias("chg")
        )
    )
    turn = changes.groupBy("date").agg(F.sum("chg").alias("turnover"))
    gross = (
        w.join(returns.select("date", "entity", ret), ["date", "entity"], "left")
        .groupBy("date")
        .agg(
            F.sum(F.col("weight") * F.coalesce(ret, F.lit(0.0))).alias("gross"),
            F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("long_exposure"),
            F.sum(F.when(F.col("weight") < 0, F.col("weight")).otherwise(0.0)).alias("short_exposure"),
            F.count("*").alias("positions"),
        )
    )
    grid = F.explode(F.array(*[F.lit(float(c)) for c in cost_bps])).alias("cost_bps")
    return (
        gross.join(turn, "date")
        .select("*", grid)
        .withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 1e4)
    )


def performance(
    df: DataFrame,
    by: Sequence[str],
    value: str = "net",
    periods: int = 12,
    order: str = "date",
) -> DataFrame:
    """Mean, volatility, Sharpe, annual return, hit rate and maximum drawdown of a series."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    level = F.exp(F.sum(F.log1p(value)).over(so_far(w)))
    d = df.filter(F.col(value).isNotNull()).withColumn("_lvl", level)
    peak = F.greatest(F.lit(1.0), F.max("_lvl").over(so_far(w)))
    d = d.withColumn("_dd", F.col("_lvl") / peak - 1)
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    return d.groupBy(*by).agg(
        n.alias("n_obs"),
        (m * periods).alias("ann_mean"),
        (s * periods**0.5).alias("ann_vol"),
        F.when(s > 0, m / s * periods**0.5).alias("sharpe"),
        F.expm1(F.sum(F.log1p(value)) * periods / n).alias("ann_return"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
        F.min("_dd").alias("max_drawdown"),
    )


def equal_weight_baseline(returns: DataFrame, ret: str = "ret") -> DataFrame:
    return returns.groupBy("date").agg(F.avg(ret).alias("net"), F.count(ret).alias("n"))


def walk_forward_weights(ic: DataFrame, shrink: float) -> DataFrame:
    """Factor weights per regime from mean ICs: shrunk to their average, floored at zero,
    normalised to 1.  Input: (regime, variable, ic)."""
    m = ic.groupBy("regime", "variable").agg(F.avg("ic").alias("mean_ic"))
    avg = m.groupBy("regime").agg(F.avg("mean_ic").alias("_a"))
    m = m.join(avg, "regime").withColumn(
        "_s", F.greatest(F.lit(0.0), (1 - shrink) * F.col("mean_ic") + shrink * F.col("_a"))
    )
    tot = m.groupBy("regime").agg(F.sum("_s").alias("_t"), F.count("*").alias("_n"))
    return m.join(tot, "regime").select(
        "regime",
        "variable",
        "mean_ic",
        F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(1 / F.col("_n")).alias("weight"),
    )


def composite_scores(signals: DataFrame, weights: DataFrame, regimes: DataFrame) -> DataFrame:
    """Regime-weighted sum of signals (date, entity, variable, value) per entity and date.

    A missing signal counts as 0; a date's weights are normalised over the variables it has.
    """
    w = regimes.select("date", "regime").join(weights.select("regime", "variable", "weight"), "regime")
    have = signals.select("date", "variable").distinct().join(w, ["date", "variable"])
    tot = have.groupBy("date").agg(F.sum("weight").alias("_t"), F.count("*").alias("_n"))
    have = have.join(tot, "date").withColumn("_w", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(1 / F.col("_n")))
    return (
        signals.join(have.select("date", "variable", "_w"), ["date", "variable"])
        .groupBy("date", "entity").agg(F.sum(F.coalesce("value", F.lit(0.0)) * F.col("_w")).alias("score"))
    )


def quintile_spread(scores: DataFrame, returns: DataFrame, k: int = 5, minimum: int = 10, ret: str = "ret") -> DataFrame:
    """Equal-weight top minus bottom k-tile of each date (tiles by position, ties by key)."""
    j = scores.join(returns.select("date", "entity", ret), ["date", "entity"]).filter(F.col(ret).isNotNull())
    p = positions(j, ["date"], "score", ["entity"], out="_p", total="_n").filter(F.col("_n") >= minimum)
    # cut points at 1 + (n-1) i/k on positions, intervals closed on the right
    p = p.withColumn("_hi", F.col("_p") > 1 + (F.col("_n") - 1) * (k - 1) / k).withColumn("_lo", F.col("_p") <= 1 + (F.col("_n") - 1) / k)
    return p.groupBy("date").agg((F.avg(F.when(F.col("_hi"), F.col(ret))) - F.avg(F.when(F.col("_lo"), F.col(ret)))).alias("ret_ls"), F.max("_n").alias("n"))


def month_end_portfolio(signal: DataFrame, returns: DataFrame, n_top: int, rebalances: DataFrame) -> DataFrame:
    """Top-N equal weights from signals strictly before each rebalance date, held until the
    next one; turnover is measured against the drifted weights.

    signal (date, entity, value), returns (date, entity, ret), rebalances (date).  A signal
    counts until the next one of its entity.  Of signals that count for the same rebalances
    only the first N can be chosen at any of them, so no more than these are spread over the
    rebalances: no grid of entities x rebalances arises.
    """
    marks = numbered(rebalances, "date")
    reb = marks.withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    s = with_boundaries_passed(signal.filter(F.col("value").isNotNull()), marks, inclusive=True, out="_lo")
    s = s.join(marks.agg(F.max("_i").alias("_last")))
    s = s.withColumn("_hi", F.coalesce(F.lead("_lo").over(Window.partitionBy("entity").orderBy("date", "value")), "_last"))
    s = s.filter("_hi > _lo").select("entity", F.col("value").alias("score"), "_lo", "_hi")
    s = positions(s, ["_lo", "_hi"], "score", ["entity"], descending=True, out="_p", total="_n").filter(F.col("_p") <= n_top)
    s = s.select("entity", "score", F.explode(F.sequence(F.col("_lo") + 1, "_hi")).alias("_i")).join(marks, "_i").select("date", "entity", "score")
    top = positions(s, ["date"], "score", ["entity"], descending=True, out="_p", total="_n").filter(F.col("_p") <= n_top)
    cnt = top.groupBy("date").agg(F.count("*").alias("_c"))
    book = top.join(cnt, "date").join(reb, "date").select(F.col("date").alias("rebalance"), "entity", (1 / F.col("_c")).alias("weight"), "_next")
    # each return date belongs to the rebalance before it: map the short list of dates
    dates = returns.select("date").distinct()
    u = dates.select("date", F.lit(1).alias("_s"), F.lit(None).cast("date").alias("_b")).unionByName(reb.select("date", F.lit(2).alias("_s"), F.col("date").alias("_b")))
    m = u.withColumn("rebalance", F.last("_b", ignorenulls=True).over(Window.orderBy("date", "_s").rowsBetween(Window.unboundedPreceding, 0))).filter("_s = 1 AND rebalance IS NOT NULL").select("date", "rebalance")
    held = returns.filter(F.col("ret").isNotNull()).join(m, "date").join(book, ["rebalance", "entity"])
    growth = held.groupBy("rebalance", "entity").agg(F.exp(F.sum(F.log1p("ret"))).alias("_g"))
    b = book.join(growth, ["rebalance", "entity"], "left").withColumn("_v", F.col("weight") * F.coalesce("_g", F.lit(1.0)))
    tot = b.groupBy("rebalance").agg(F.sum("_v").alias("_t"))
    b = b.join(tot, "rebalance").withColumn("_drift", F.col("_v") / F.col("_t"))
    prev = b.filter(F.col("_next").isNotNull()).select(F.col("_next").alias("rebalance"), "entity", F.col("_drift").alias("_old"))
    chg = b.select("rebalance", "entity", "weight").join(prev, ["rebalance", "entity"], "full").groupBy("rebalance").agg(
        (F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))) / 2).alias("turnover"))
    ret = tot.withColumn("period_return", F.col("_t") - 1).select("rebalance", "period_return")
    return ret.join(chg, "rebalance")


def half_sample_funnel(df: DataFrame, prior: str, half_min: float = 0.0, deflated_min: float = -10.0, min_half: int = 24, periods: int = 12) -> DataFrame:
    """Factors matching a prior with both variants, positive in both halves and above the
    deflation term in both variants; input (factor, date, value) with _CS/_TS names."""
    from ..plans.harness import expected_max_sharpe

    d = df.filter(F.col("value").isNotNull() & F.col("factor").rlike("_(CS|TS)$")).withColumns(
        {"base": F.regexp_replace("factor", "_(CS|TS)$", ""), "variant": F.regexp_extract("factor", "_(CS|TS)$", 1)}).filter(F.col("base").rlike(prior))
    w = Window.partitionBy("factor").orderBy("date")
    d = d.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("factor"))}).withColumn("_h", F.when(F.col("_i") <= F.floor(F.col("_n") / 2), 1).otherwise(2))

    def sh(c: Column) -> Column:
        v = F.when(c, F.col("value"))
        return F.avg(v) / F.stddev_samp(v) * periods**0.5

    h1, h2 = F.col("_h") == 1, F.col("_h") == 2
    v = d.groupBy("base", "variant").agg(F.count("*").alias("n"), F.count(F.when(h1, 1)).alias("n1"), F.count(F.when(h2, 1)).alias("n2"), sh(F.lit(True)).alias("sharpe"), sh(h1).alias("s1"), sh(h2).alias("s2"))
    pairs = v.groupBy("base").agg(F.count("*").alias("_v"), F.min("n").alias("n_obs"), F.min(F.least("n1", "n2")).alias("_mh"), F.min("sharpe").alias("min_sharpe"), F.min(F.least("s1", "s2")).alias("min_half_sharpe")).filter("_v = 2")
    tot = pairs.agg((F.count("*") * 2).alias("_trials"), F.percentile("n_obs", F.lit(0.5)).alias("_T"))
    j = pairs.join(tot).withColumn("deflation", expected_max_sharpe(F.col("_trials"), F.col("_T")) * periods**0.5)
    keep = (F.col("_mh") >= min_half) & (F.col("min_half_sharpe") > half_min) & (F.col("min_sharpe") - F.col("deflation") >= deflated_min)
    return j.select("base", "n_obs", "min_sharpe", "min_half_sharpe", "deflation", keep.alias("survives"))


def walk_forward_ridge(features: DataFrame, returns: DataFrame, names: Sequence[str], alpha: float = 1.0, minimum: int = 4, min_rows: int = 200) -> DataFrame:
    """Scores from a ridge refit every year on all earlier rows.

    features (date, entity, variable, value) signed so that higher is better: z per date,
    at least ``minimum`` present, missing ones 0; label = next row's return less its date
    mean.  The normal equations of each year are sums, accumulated over years; only
    years x d x d numbers are solved, in the job.
    """
    import numpy as np
    import pandas as pd

    from .normalise import cross_z

    d = len(names)
    z = cross_z(features.filter(F.col("variable").isin(*names)), ("date", "variable"))
    wide = z.groupBy("date", "entity").agg(*[F.coalesce(F.max(F.when(F.col("variable") == v, F.col("z"))), F.lit(0.0)).alias(f"x{i}") for i, v in enumerate(names)], F.count("z").alias("_c")).filter(F.col("_c") >= minimum)
    nxt = returns.withColumn("_y", F.lead("ret").over(Window.partitionBy("entity").orderBy("date"))).select("date", "entity", "_y")
    mean = nxt.groupBy("date").agg(F.avg("_y").alias("_m"))
    j = wide.join(nxt.join(mean, "date").withColumn("_y", F.col("_y") - F.col("_m")).drop("_m"), ["date", "entity"], "left")
    lab = j.filter(F.col("_y").isNotNull())
    cols = [F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"g{a}_{b}") for a in range(d) for b in range(a, d)] + [F.sum(F.col(f"x{a}") * F.col("_y")).alias(f"b{a}") for a in range(d)]
    per = lab.groupBy(F.year("date").alias("_year")).agg(*cols, F.count("*").alias("_n"))
    # cumulative sums up to the year before; the last label of a year ends in the next one
    w = Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    cum = per.select("_year", *[F.sum(c).over(w).alias(c) for c in per.columns if c != "_year"]).filter(F.col("_n") >= min_rows)

    def solve(batches):
        for p in batches:
            out = []
            for _, r in p.iterrows():
                g = np.zeros((d, d))
                for a in range(d):
                    for b in range(a, d):
                        g[a, b] = g[b, a] = r[f"g{a}_{b}"]
                out.append((int(r["_year"]), np.linalg.solve(g + alpha * np.eye(d), np.array([r[f"b{a}"] for a in range(d)])).tolist()))
            yield pd.DataFrame(out, columns=["_year", "_coef"])

    coef = cum.mapInPandas(solve, "_year int, _coef array<double>")
    score = sum(F.col(f"x{i}") * F.col("_coef")[i] for i in range(d))
    return wide.withColumn("_year", F.year("date")).join(coef, "_year").select("date", "entity", score.alias("score"))
