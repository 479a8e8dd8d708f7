"""Signal evaluation: alignment, rank IC, backtests with costs, deflated Sharpe, verdicts.

Everything is keyed by ``signal``, so one signal or a sweep over thousands is the same plan
and one job.  Signals: (signal, date, entity, value); returns: (date, entity, ret).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import month_number, norm_cdf, norm_ppf, ratio, so_far
from ..functions.ranks import average_ranks, positions
from ..session import settle

# Annual borrow cost, cost grid in basis points, gates and sub-periods.
BORROW_BPS = 50.0
COST_BPS = (5.0, 10.0, 25.0, 50.0)
GATE_T, WEAK_T, GATE_YEARS = 2.5, 1.5, 0.60
SUBPERIODS = (
    ("2008-2012", "2008-01-01", "2012-12-31"),
    ("2013-2017", "2013-01-01", "2017-12-31"),
    ("2018-2022", "2018-01-01", "2022-12-31"),
    ("2023-now", "2023-01-01", "2099-12-31"),
)
EULER_GAMMA = 0.5772156649


def align_monthly(signals: DataFrame, returns: DataFrame, horizons: Sequence[int], lag: int | Column = 0) -> DataFrame:
    """Signal of month M with the compounded return over (M+lag, M+lag+h], for each h.

    Two equi joins on a month number against the cumulative log return serve all horizons.
    """
    lag = lag if isinstance(lag, Column) else F.lit(lag)
    c = returns.withColumn("_m", month_number("date")).select(
        "entity", "_m", F.sum(F.log1p("ret")).over(so_far(Window.partitionBy("entity").orderBy("_m"))).alias("_cum")
    )
    s = signals.filter(F.col("value").isNotNull()).withColumn("_s", month_number("date") + lag)
    s = s.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("_e", F.col("_s") + F.col("horizon"))
    a = c.select("entity", F.col("_m").alias("_s"), F.col("_cum").alias("_a"))
    b = c.select("entity", F.col("_m").alias("_e"), F.col("_cum").alias("_b"))
    return (
        s.join(a, ["entity", "_s"]).join(b, ["entity", "_e"])
        .withColumn("fwd_return", F.expm1(F.col("_b") - F.col("_a")))
        .filter(F.col("fwd_return").isNotNull())
        .drop("_s", "_e", "_a", "_b")
    )


def align_daily(signals: DataFrame, returns: DataFrame, horizons: Sequence[int], lag: int = 0) -> DataFrame:
    """The same on each entity's own trading days; windows are leads of the entity calendar."""
    w = Window.partitionBy("entity").orderBy("date")
    c = returns.filter(F.col("ret").isNotNull()).withColumn("_cum", F.sum(F.log1p("ret")).over(so_far(w)))
    start = F.lead("_cum", lag).over(w) if lag else F.col("_cum")
    cols = [F.struct(F.lit(h).alias("horizon"), F.expm1(F.lead("_cum", lag + h).over(w) - start).alias("fwd_return")) for h in horizons]
    fwd = c.select("entity", "date", F.array(*cols).alias("_f")).select("entity", "date", F.explode("_f").alias("_f"))
    fwd = fwd.select("entity", "date", "_f.horizon", "_f.fwd_return").filter(F.col("fwd_return").isNotNull())
    return signals.filter(F.col("value").isNotNull()).join(fwd, ["entity", "date"])


def rank_ic(aligned: DataFrame, by: Sequence[str] = ("signal", "horizon"), minimum: int = 10, distinct: int = 3) -> DataFrame:
    """Spearman rank IC (average ties) per date; thin or flat cross-sections are dropped."""
    g = [*by, "date"]
    d = settle(aligned.select(*g, "value", "fwd_return"))
    d = average_ranks(d, g, "value", out="_rx", total="_n", distinct="_d")
    d = average_ranks(d, g, "fwd_return", out="_ry", total="_n2")
    return (
        d.groupBy(*g)
        .agg(F.corr("_rx", "_ry").alias("ic"), F.max("_n").alias("n_entities"), F.max("_d").alias("_d"))
        .filter((F.col("n_entities") >= minimum) & (F.col("_d") >= distinct) & F.col("ic").isNotNull() & ~F.isnan("ic"))
        .drop("_d")
    )


def newey_west(df: DataFrame, by: Sequence[str], value: str, lag: str | int, max_lag: int, order: str = "date", minimum: int = 8) -> DataFrame:
    """Bartlett-kernel t-statistic of a series mean.

    ``lag`` is the kernel lag per series (a column or a number) up to ``max_lag``; the
    autocovariances are sums of products with window lags, all over one sort.
    """
    by = list(by)
    w = Window.partitionBy(*by)
    o = w.orderBy(order)
    d = df.filter(F.col(value).isNotNull()).withColumns({"_mu": F.avg(value).over(w), "_T": F.count("*").over(w)})
    d = d.withColumn("_e", F.col(value) - F.col("_mu"))
    want = F.col(lag) if isinstance(lag, str) else F.lit(lag)
    L = F.least(want, F.col("_T") - 1)
    acc = F.col("_e") * F.col("_e")
    for k in range(1, max_lag + 1):
        kernel = 2 * (1 - F.lit(float(k)) / (L + 1))
        term = F.when(L >= k, kernel * F.col("_e") * F.coalesce(F.lag("_e", k).over(o), F.lit(0.0)))
        acc = acc + F.coalesce(term, F.lit(0.0))
    d = d.withColumn("_g", acc)
    s = d.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.sum("_g").alias("_s"))
    lrv = F.col("_s") / F.col("n")
    return s.withColumn(
        "nw_t", F.when((F.col("n") >= minimum) & (lrv > 0), F.col("mean") / F.sqrt(lrv / F.col("n")))
    ).drop("_s")


def yearly_ic(ic: DataFrame, by: Sequence[str] = ("signal", "horizon")) -> DataFrame:
    return ic.groupBy(*by, F.year("date").cast("long").alias("year")).agg(F.round(F.avg("ic"), 4).alias("mean_ic"))


def ic_summary(ic: DataFrame, max_horizon: int, by: Sequence[str] = ("signal", "horizon"), direction: str | None = None) -> DataFrame:
    """Mean IC, Newey-West t with the horizon as lag, and the share of positive years."""
    t = newey_west(ic, by, "ic", "horizon", max_horizon)
    y = yearly_ic(ic, by).groupBy(*by).agg(
        F.avg((F.col("mean_ic") > 0).cast("double")).alias("pct_positive_years"),
        F.avg((F.col("mean_ic") < 0).cast("double")).alias("pct_negative_years"),
    )
    return t.join(y, list(by)).select(
        *by, F.round("mean", 4).alias("mean_ic"), F.round("nw_t", 3).alias("nw_t"), F.col("n").alias("n_dates"),
        F.round("pct_positive_years", 3).alias("pct_positive_years"), F.round("pct_negative_years", 3).alias("pct_negative_years"),
    )


def top_bottom(scored: DataFrame, n_top: int, minimum: int, by: Sequence[str] = ("signal",), score: str = "score") -> DataFrame:
    """Members of the top and bottom n of each date with enough scores: side is +1 or -1."""
    p = positions(scored, [*by, "date"], score, ["entity"], descending=True, out="_p", total="_n").filter(F.col("_n") >= minimum)
    side = F.array_compact(F.array(F.when(F.col("_p") <= n_top, F.lit(1)), F.when(F.col("_p") > F.col("_n") - n_top, F.lit(-1))))
    return p.withColumn("side", F.explode(side)).drop("_p", "_n")


def backtest_monthly(
    aligned: DataFrame, n_top: int = 7, minimum: int = 14, by: Sequence[str] = ("signal",), sign: Column | float = 1.0
) -> DataFrame:
    """Date rows: top, bottom and equal-weight return, one-way turnover against the book of
    the date kept before.  ``aligned`` is the one-period alignment."""
    by = list(by)
    s = aligned.withColumn("score", (sign if isinstance(sign, Column) else F.lit(float(sign))) * F.col("value"))
    n = s.groupBy(*by, "date").agg(F.count("score").alias("_n"), F.avg("fwd_return").alias("ret_ew")).filter(F.col("_n") >= minimum)
    kept = n.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("date"))).drop("_n")
    m = top_bottom(s, n_top, minimum, by).join(kept.select(*by, "date", "_k"), [*by, "date"])
    w = Window.partitionBy(*by, "entity", "side").orderBy("_k")
    m = m.withColumn("_new", ~F.lag("_k").over(w).eqNullSafe(F.col("_k") - 1))
    top, bot = F.col("side") == 1, F.col("side") == -1
    b = m.groupBy(*by, "date").agg(
        F.avg(F.when(top, F.col("fwd_return"))).alias("ret_top"),
        F.avg(F.when(bot, F.col("fwd_return"))).alias("ret_bot"),
        F.count(F.when(top & F.col("_new"), 1)).alias("_nt"),
        F.count(F.when(bot & F.col("_new"), 1)).alias("_nb"),
    )
    first = F.col("_k") == 1
    tt = F.when(first, 1.0).otherwise(F.col("_nt") / n_top)
    tb = F.when(first, 1.0).otherwise(F.col("_nb") / n_top)
    return b.join(kept, [*by, "date"]).select(
        *by, "date", "ret_top", "ret_bot", "ret_ew", tt.alias("turnover_top"), (tt + tb).alias("turnover_ls")
    )


def backtest_daily(
    signals: DataFrame, returns: DataFrame, hold: int, n_top: int = 7, minimum: int = 14, by: Sequence[str] = ("signal",),
    sign: Column | float = 1.0, min_ew: int = 14,
) -> DataFrame:
    """Overlapping tranches: rank date i re-ranks tranche i mod hold; the basket earns from
    the next return date until the tranche's next basket takes over.

    Turnover is charged on the rank date (scaled by the tranche's share), if the book has a
    return row that day.
    """
    by = list(by)
    s = signals.withColumn("score", (sign if isinstance(sign, Column) else F.lit(float(sign))) * F.col("value"))
    cal = returns.filter(F.col("ret").isNotNull()).select("date").distinct().withColumn("_p", F.row_number().over(Window.orderBy("date")))
    end = cal.agg(F.max("_p").alias("_end"))
    rank_dates = (
        s.filter(F.col("score").isNotNull()).groupBy(*by, "date").agg(F.count("*").alias("_n")).filter(F.col("_n") >= minimum)
        .withColumn("_k", (F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1) % hold)
        .join(cal, "date")
    )
    nxt = F.lead("_p").over(Window.partitionBy(*by, "_k").orderBy("_p"))
    rank_dates = rank_dates.withColumn("_seq", F.row_number().over(Window.partitionBy(*by, "_k").orderBy("_p"))).withColumn("_next", nxt).join(end)
    m = top_bottom(s, n_top, minimum, by).select(*by, "date", "entity", "side").join(
        rank_dates.select(*by, "date", "_k", "_p", "_seq", F.coalesce("_next", "_end").alias("_stop")), [*by, "date"]
    )
    # turnover of each re-ranking
    w = Window.partitionBy(*by, "_k", "entity", "side").orderBy("_seq")
    fresh = m.withColumn("_new", ~F.lag("_seq").over(w).eqNullSafe(F.col("_seq") - 1))
    turn = fresh.groupBy(*by, "_p", "_seq").agg(
        F.count(F.when((F.col("side") == 1) & F.col("_new"), 1)).alias("_nt"),
        F.count(F.when((F.col("side") == -1) & F.col("_new"), 1)).alias("_nb"),
    )
    first = F.col("_seq") == 1
    turn = turn.select(
        *by, "_p",
        (F.when(first, 1.0).otherwise(F.col("_nt") / n_top) / hold).alias("_tt"),
        (F.when(first, 1.0).otherwise(F.col("_nb") / n_top) / hold).alias("_tb"),
    )
    # live days of each basket
    live = m.filter(F.col("_stop") > F.col("_p")).withColumn("_p", F.explode(F.sequence(F.col("_p") + 1, F.col("_stop"))))
    r = returns.filter(F.col("ret").isNotNull()).join(cal, "date").select("_p", "entity", "ret")
    tr = live.join(r, ["_p", "entity"]).groupBy(*by, "_p", "_k").agg(
        F.avg(F.when(F.col("side") == 1, F.col("ret"))).alias("_t"),
        F.count(F.when(F.col("side") == 1, 1)).alias("_nt"),
        F.avg(F.when(F.col("side") == -1, F.col("ret"))).alias("_b"),
    ).filter(F.col("_nt") >= max(3, n_top - 3))
    day = tr.groupBy(*by, "_p").agg(F.avg("_t").alias("ret_top"), F.avg(F.coalesce("_b", F.lit(0.0))).alias("ret_bot"))
    ew = r.groupBy("_p").agg(F.avg("ret").alias("ret_ew"), F.count("*").alias("_c")).filter(F.col("_c") >= min_ew).drop("_c")
    zero = F.lit(0.0)
    return (
        day.join(ew, "_p").join(turn, [*by, "_p"], "left").join(cal, "_p")
        .select(
            *by, "date", "ret_top", "ret_bot", "ret_ew",
            F.coalesce("_tt", zero).alias("turnover_top"), (F.coalesce("_tt", zero) + F.coalesce("_tb", zero)).alias("turnover_ls"),
        )
    )


def _ann(c: Column, periods: int) -> Column:
    return F.round(F.expm1(F.sum(F.log1p(c)) * periods / F.count(c)), 4)


def _sharpe(c: Column, periods: int) -> Column:
    s = F.stddev_samp(c)
    return F.round(F.when((F.count(c) >= periods) & (s > 0), F.avg(c) / s * math.sqrt(periods)), 3)


def backtest_summary(bt: DataFrame, by: Sequence[str] = ("signal",), periods: int = 12, minimum: int = 24) -> DataFrame:
    """Gross figures, breakeven cost and the net figures at every cost, one row per signal."""
    borrow = BORROW_BPS / 1e4 / periods
    ls = F.col("ret_top") - F.col("ret_bot")
    aggs = [
        F.count("*").alias("n_periods"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.round(F.avg("turnover_top"), 5).alias("turnover_top"), F.round(F.avg("turnover_ls"), 5).alias("turnover_ls"),
        F.round((F.avg(ls) - borrow) / (2 * F.avg("turnover_ls")) * 1e4, 1).alias("breakeven_bps"),
        _ann(F.col("ret_top"), periods).alias("top_ann"), _ann(F.col("ret_ew"), periods).alias("ew_ann"),
        _ann(ls, periods).alias("ls_ann"), _sharpe(ls, periods).alias("ls_sharpe"),
        _sharpe(F.col("ret_top") - F.col("ret_ew"), periods).alias("top_excess_sharpe"),
    ]
    for c in COST_BPS:
        k = c / 1e4
        top = F.col("ret_top") - F.col("turnover_top") * 2 * k
        net = ls - F.col("turnover_ls") * 2 * k - borrow
        aggs += [
            (_ann(top, periods) - _ann(F.col("ret_ew"), periods)).alias(f"top_excess_net{int(c)}"),
            _ann(net, periods).alias(f"ls_ann_net{int(c)}"), _sharpe(net, periods).alias(f"ls_sharpe_net{int(c)}"),
        ]
    return bt.groupBy(*by).agg(*aggs).filter(F.col("n_periods") >= minimum)


def net_series(bt: DataFrame, cost_bps: float = 25.0, periods: int = 12) -> DataFrame:
    net = F.col("ret_top") - F.col("ret_bot") - F.col("turnover_ls") * 2 * cost_bps / 1e4 - BORROW_BPS / 1e4 / periods
    return bt.withColumn("net", net)


def subperiod_table(bt: DataFrame, by: Sequence[str] = ("signal",), periods: int = 12, table=SUBPERIODS) -> DataFrame:
    """Observations, top excess and long-short Sharpe per named sub-period (NULL when thin)."""
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).cast("date").alias("s"), F.lit(e).cast("date").alias("e")) for n, s, e in table])
    d = bt.withColumn("_s", F.explode(rows)).filter((F.col("date") >= F.col("_s.s")) & (F.col("date") <= F.col("_s.e")))
    ls = F.col("ret_top") - F.col("ret_bot")
    g = d.groupBy(*by, F.col("_s.n").alias("subperiod")).agg(
        F.count("*").alias("n_obs"), (_ann(F.col("ret_top"), periods) - _ann(F.col("ret_ew"), periods)).alias("top_excess_ann"),
        _sharpe(ls, periods).alias("ls_sharpe"),
    )
    return g.withColumn("top_excess_ann", F.when(F.col("n_obs") >= periods, F.col("top_excess_ann")))


def expected_max_sharpe(n_trials: Column, n_obs: Column) -> Column:
    """Expected maximum per-period Sharpe of n trials of pure noise."""
    n = F.greatest(n_trials.cast("double"), F.lit(1.0))
    z = (1 - EULER_GAMMA) * norm_ppf(1 - 1 / n) + EULER_GAMMA * norm_ppf(1 - 1 / (n * math.e))
    return F.when(n_obs < 3, None).when(n == 1, 0.0).otherwise(F.sqrt(1 / (n_obs - 1)) * z)


def deflated_sharpe(
    df: DataFrame, by: Sequence[str], value: str, n_trials: Column | int, periods: int = 12
) -> DataFrame:
    """Per-period Sharpe less the expected maximum of the family's trials, and the probability
    that it exceeds it (skew and kurtosis adjusted)."""
    nt = n_trials if isinstance(n_trials, Column) else F.lit(n_trials)
    s = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.skewness(value).alias("_k3"),
        (F.kurtosis(value) + 3).alias("_k4"), F.count(value).alias("n_obs"),
    )
    s = s.withColumn("_sr", F.when((F.col("n_obs") >= 2 * periods) & (F.col("_s") > 0), F.col("_m") / F.col("_s")))
    s = s.withColumn("_em", expected_max_sharpe(nt, F.col("n_obs")))
    den = F.sqrt(F.greatest(1 - F.col("_k3") * F.col("_sr") + (F.col("_k4") - 1) / 4 * F.col("_sr") ** 2, F.lit(1e-9)))
    prob = norm_cdf((F.col("_sr") - F.col("_em")) * F.sqrt(F.col("n_obs") - 1) / den)
    return s.select(
        *by, "n_obs", F.round("_sr", 4).alias("sharpe_per_period"), F.round(F.col("_sr") * math.sqrt(periods), 3).alias("sharpe_annualised"),
        F.round("_em", 4).alias("expected_max"), F.round(F.col("_sr") - F.col("_em"), 4).alias("deflated_sharpe"),
        F.round(prob, 4).alias("prob_exceeds"),
    )


def verdict(
    coverage_fail: Column, history_fail: Column, t: Column, years: Column, ls_sharpe: Column, top_excess: Column, dsr: Column,
    no_portfolio: Column,
) -> Column:
    """Gates in order: coverage, history, then t / years / cost / deflation."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    g_t, g_y = ok(t >= GATE_T), ok(years >= GATE_YEARS)
    g_c, g_d = ok(ls_sharpe > 0) & ok(top_excess > 0), ok(dsr > 0)
    return (
        F.when(ok(coverage_fail), "INSUFFICIENT_COVERAGE")
        .when(ok(history_fail), "INSUFFICIENT_HISTORY")
        .when(g_t & g_y & (ok(no_portfolio) | (g_c & g_d)), "WATCH")
        .when(ok(t >= WEAK_T), "WEAK")
        .otherwise("DEAD")
    )


# Median gap in days -> publication lag in months.
LAG_BY_GAP = ((45, 1), (135, 3))


def publication_lag(signals: DataFrame, market_sources: Sequence[str] = (), by: Sequence[str] = ("signal",)) -> DataFrame:
    """Monthly publication lag per signal: 0 for market data, else by its native frequency."""
    w = Window.partitionBy(*by, "entity").orderBy("date")
    g = signals.withColumn("_g", F.datediff("date", F.lag("date").over(w))).groupBy(*by).agg(
        F.percentile("_g", F.lit(0.5)).alias("median_gap"), F.max(F.col("source").isin(*market_sources)).alias("_z")
    )
    m = F.coalesce("median_gap", F.lit(31.0))
    lag = F.when(F.col("_z"), 0)
    for edge, months in LAG_BY_GAP:
        lag = lag.when(m <= edge, months)
    return g.select(*by, "median_gap", lag.otherwise(12).cast("long").alias("lag_months"))


def daily_lag(registry: DataFrame | None, signals: DataFrame, market_sources: Sequence[str], conservative: int = 1) -> DataFrame:
    """Daily publication lag: 0 for market data, the entitled lag of a passing proof, else
    the conservative default (fail closed)."""
    s = signals.select("signal", "variable", "source").distinct()
    p = registry.filter(F.col("status") == "passing").select("variable", F.col("entitled_lag").alias("_l"))
    return s.join(p, "variable", "left").select(
        "signal", "variable",
        F.when(F.col("source").isin(*market_sources), 0).otherwise(F.coalesce("_l", F.lit(conservative))).cast("long").alias("lag_days"),
    )


def load_signal(panel: DataFrame, signal: str, variable: str, source: str | None = None) -> DataFrame:
    """One signal out of a panel; forward returns are refused, several sources are ambiguous."""
    from ..operators.keys import refuse_forward_returns

    d = panel.filter(F.col("variable") == refuse_forward_returns(variable))
    if source:
        d = d.filter(F.col("source") == source)
    else:
        n = d.select("source").distinct().limit(2).count()
        if n > 1:
            raise ValueError(f"{variable!r} comes from several sources; name one")
    return d.select(F.lit(signal).alias("signal"), "date", "entity", "value", "source")


def evaluate(
    signals: DataFrame, returns: DataFrame, horizons: Sequence[int] = (1, 3, 6), lag: int = 0, n_trials: int | Column = 1,
    universe: int | None = None, n_top: int | None = None, min_history: int = 60, primary: int | None = None,
) -> DataFrame:
    """Full monthly evaluation of every signal: IC block at the primary horizon, coverage and
    history gates, portfolio, deflated Sharpe and verdict.

    ``universe`` is the number of entities the coverage gate is proportional to (default:
    counted from the returns); ``direction`` (+1/-1), if present, flips the sign.
    """
    if universe is None:
        universe = returns.select("entity").distinct().count()
    if n_top is None:
        n_top = 7 if universe >= 34 else max(3, universe // 3)
    min_cov = 28 if universe == 34 else max(10, math.ceil(0.8 * universe))
    min_xs = max(10, 2 * n_top)
    first = primary if primary is not None else horizons[0]
    if first not in horizons:
        raise ValueError(f"primary horizon {first} is not evaluated")
    sign = F.col("direction").cast("double") if "direction" in signals.columns else F.lit(1.0)
    sg = signals.withColumn("_sign", sign)
    aligned = settle(align_monthly(sg, returns, sorted({1, *horizons}), lag))  # read by every block below
    ic = ic_summary(settle(rank_ic(aligned.filter(F.col("horizon").isin(*horizons)))), max(horizons))
    prim = ic.filter(F.col("horizon") == first)
    cov = aligned.filter(F.col("horizon") == first).groupBy("signal", "date").agg(F.countDistinct("entity").alias("_c"), F.max("_sign").alias("_sign"))
    gates = cov.groupBy("signal").agg(
        (F.avg((F.col("_c") >= min_cov).cast("double")) < 0.95).alias("coverage_fail"), (F.count("*") < min_history).alias("history_fail"),
        F.max("_sign").alias("_sign"),
    )
    bt = settle(backtest_monthly(aligned.filter(F.col("horizon") == 1), n_top, min_xs, sign=F.col("_sign")))
    perf = backtest_summary(bt).select("signal", "ls_sharpe_net25", "top_excess_net25", "ls_sharpe", "turnover_ls")
    dsr = deflated_sharpe(net_series(bt), ["signal"], "net", n_trials).select("signal", "deflated_sharpe")
    j = gates.join(prim, "signal", "left").join(perf, "signal", "left").join(dsr, "signal", "left")
    t = F.col("nw_t") * F.col("_sign")
    years = F.when(F.col("_sign") < 0, F.col("pct_negative_years")).otherwise(F.col("pct_positive_years"))
    v = verdict(F.col("coverage_fail"), F.col("history_fail"), t, years, F.col("ls_sharpe_net25"), F.col("top_excess_net25"), F.col("deflated_sharpe"), F.col("ls_sharpe_net25").isNull() & F.col("top_excess_net25").isNull())
    return j.select("signal", "mean_ic", t.alias("nw_t"), years.alias("pct_years"), "n_dates", "coverage_fail", "history_fail", "ls_sharpe", "ls_sharpe_net25", "top_excess_net25", "turnover_ls", "deflated_sharpe", v.alias("verdict"))


def hold_grid(signals: DataFrame, returns: DataFrame, holds: Sequence[int] = (1, 5, 21), **kw) -> DataFrame:
    """Daily backtest summary at several hold periods (the list is short and fixed)."""
    out = None
    for h in holds:
        s = backtest_summary(backtest_daily(signals, returns, h, **kw), periods=252, minimum=252).withColumn("hold", F.lit(h).cast("long"))
        out = s if out is None else out.unionByName(s)
    return out


def store_ic(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """IC series store: the rows of a run replace the stored rows of the same run."""
    return stored.join(fresh.select("run_id").distinct(), "run_id", "left_anti").unionByName(fresh)


def spanning(df: DataFrame, factors: DataFrame, models: dict[str, Sequence[str]], minimum: int = 36) -> DataFrame:
    """OLS of each entity's return on each model's factors with Bartlett HAC errors.

    df (date, entity, ret); factors (date, factor, value).  One task solves one
    (entity, model); a series has one row per date and at most a handful of factors.
    """
    rows = [F.struct(F.lit(m).alias("model"), F.array(*[F.lit(x) for x in fs]).alias("fs")) for m, fs in models.items()]
    # the date's factor values ride along as one map (a handful of factors)
    fmap = factors.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("factor", "value"))).alias("_f"))
    d = df.filter(F.col("ret").isNotNull()).join(fmap, "date").withColumn("_m", F.explode(F.array(*rows)))
    d = d.select("entity", "date", "ret", F.col("_m.model").alias("model"), F.transform("_m.fs", lambda x: F.col("_f")[x]).alias("_x"))
    d = d.filter(~F.exists("_x", lambda v: v.isNull()))
    kind = df.schema["entity"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        n = len(pdf)
        cols = ["entity", "model", "n_obs", "alpha", "alpha_t", "r2", "betas"]
        if n < minimum:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})
        y = pdf["ret"].to_numpy(float)
        x = np.column_stack([np.ones(n), np.vstack(pdf["_x"].to_numpy())])
        g = np.linalg.pinv(x.T @ x)
        b = g @ x.T @ y
        e = y - x @ b
        lag = int(np.floor(4 * (n / 100.0) ** (2.0 / 9.0)))
        u = x * e[:, None]
        s = u.T @ u
        for k in range(1, lag + 1):
            c = u[k:].T @ u[:-k]
            s += (1 - k / (lag + 1)) * (c + c.T)
        v = g @ s @ g
        tot = ((y - y.mean()) ** 2).sum()
        return pd.DataFrame({"entity": [pdf["entity"].iloc[0]], "model": [pdf["model"].iloc[0]], "n_obs": [n], "alpha": [b[0]],
                             "alpha_t": [b[0] / np.sqrt(v[0, 0])], "r2": [1 - (e @ e) / tot], "betas": [b[1:].tolist()]})[cols]

    return d.groupBy("entity", "model").applyInPandas(solve, f"entity {kind}, model string, n_obs long, alpha double, alpha_t double, r2 double, betas array<double>")


def reverdict(stored: DataFrame, trials: DataFrame) -> DataFrame:
    """Stored runs (signal, family, n_obs, sharpe_per_period and gate metrics) under new family
    trial counts (family, n_trials)."""
    j = stored.join(trials, "family")
    em = expected_max_sharpe(F.col("n_trials"), F.col("n_obs"))
    d = F.round(F.col("sharpe_per_period") - em, 4)
    no = F.lit(False)
    return j.withColumn("deflated_sharpe", d).withColumn(
        "verdict", verdict(no, no, F.col("nw_t"), F.col("pct_years"), F.col("ls_sharpe_net25"), F.col("top_excess_net25"), F.col("deflated_sharpe"), no)
    )
