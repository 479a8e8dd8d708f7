"""Normalisation and portfolio queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import normalise as N
from ..operators import portfolio as P
from . import base as B
from .base import query

CS_SQL = """SELECT date, entity, variable,
    CASE WHEN count(value) OVER g >= 2 AND stddev_pop(value) OVER g > 0
         THEN (value - avg(value) OVER g)/stddev_pop(value) OVER g END AS z
  FROM {monthly} WINDOW g AS (PARTITION BY date, variable)"""

BAND = """CASE WHEN rp < 0.15 THEN 1.0 WHEN rp <= 0.25 THEN 1 - (rp-0.15)/(0.25-0.15) ELSE 0 END"""

MEMBERS_SQL = f"""s AS (SELECT date, entity, variable, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS z
    FROM {{monthly}} WINDOW g AS (PARTITION BY date, variable)),
  r AS (SELECT s.*, m.ret FROM s JOIN {{mret}} m USING (date, entity) WHERE z IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY variable, date ORDER BY z DESC, entity)::DOUBLE
        / count(*) OVER (PARTITION BY variable, date) AS rp FROM r),
  w AS (SELECT *, {BAND} AS w0 FROM k),
  m AS (SELECT *, w0/sum(w0) OVER (PARTITION BY variable, date) AS weight FROM w WHERE w0 > 0),
  bench AS (SELECT date, avg(ret) AS bench FROM {{mret}} GROUP BY 1)"""


@query("W1_cross_z", CS_SQL, "z")
def _(t):
    return N.cross_z(B.monthly(t)).select("date", "entity", "variable", "z")


@query("W2_cross_z_sample", """SELECT date, entity, variable,
    CASE WHEN stddev_samp(value) OVER g = 0 THEN 0 ELSE (value - avg(value) OVER g)/stddev_samp(value) OVER g END AS z
  FROM {monthly} WINDOW g AS (PARTITION BY date, variable)""", "z")
def _(t):
    return N.cross_z(B.monthly(t), ddof=1, on_zero=0.0).select("date", "entity", "variable", "z")


@query("W3_peer_z", """SELECT date, entity, variable, CASE WHEN ps = 0 THEN 0 ELSE (value-pm)/ps END AS z FROM (
   SELECT *, CASE WHEN n>=2 THEN sqrt(greatest(0, (s2-value*value)/(n-1) - pm*pm)) END AS ps FROM (
    SELECT *, CASE WHEN n>=2 THEN (s1-value)/(n-1) END AS pm FROM (
     SELECT *, sum(value) OVER g AS s1, sum(value*value) OVER g AS s2, count(value) OVER g AS n
     FROM {monthly} WINDOW g AS (PARTITION BY date, variable))))""", "z")
def _(t):
    return N.peer_z(B.monthly(t)).select("date", "entity", "variable", "z")


@query("W4_percent_rank_average", """SELECT date, entity, variable,
    (rank() OVER (PARTITION BY date, variable ORDER BY n) + (count(*) OVER (PARTITION BY date, variable, n)-1)/2.0)
     / count(*) OVER (PARTITION BY date, variable) AS pct FROM {user_daily}""", "pct")
def _(t):
    return N.percent_rank_average(B.user_daily(t), value="n").select("date", "entity", "variable", "pct")


@query("W5_oriented_rank", """SELECT date, entity, rank FROM (SELECT date, entity,
     row_number() OVER (PARTITION BY date ORDER BY value, entity) AS rank, count(*) OVER (PARTITION BY date) AS n
     FROM {daily}) WHERE n >= 5""")
def _(t):
    return N.oriented_rank(B.daily(t), higher_is_better=False).select("date", "entity", "rank")


@query("W6_rolling_z", """SELECT date, entity, variable, CASE WHEN count(value) OVER f >= 24 AND stddev_pop(value) OVER f > 0
    THEN (value-avg(value) OVER f)/stddev_pop(value) OVER f END AS z FROM {monthly}
  WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS 59 PRECEDING)""", "z")
def _(t):
    return N.rolling_z(B.monthly(t), 60, 24).select("date", "entity", "variable", "z")


@query("W7_prior_window_z", """SELECT date, entity, CASE WHEN count(value) OVER f >= 60 AND stddev_samp(value) OVER f > 0
    THEN (value-avg(value) OVER f)/stddev_samp(value) OVER f END AS z FROM {daily}
  WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""", "z")
def _(t):
    return N.rolling_z(B.daily(t), 252, 60, ddof=1, prior=True).select("date", "entity", "z")


@query("W8_surprise_scale", """WITH z AS (SELECT date, entity, variable, CASE WHEN count(value) OVER f >= 12 AND stddev_samp(value) OVER f > 0
    THEN value/stddev_samp(value) OVER f END AS value FROM {monthly}
    WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING))
  SELECT date, entity, avg(CASE WHEN variable='R' THEN -value ELSE value END) AS value, count(value) AS legs,
    'GROWTH' AS variable FROM z GROUP BY 1,2""", "value")
def _(t):
    z = N.surprise_scale(B.monthly(t), 36, 12).select("date", "entity", "variable", F.col("z").alias("value"))
    return N.signed_composite(z, {"A": 1, "N": 1, "R": -1}, "GROWTH")


@query("W9_expanding_z", """SELECT date, entity, variable, CASE WHEN count(value) OVER f >= 24 THEN
    CASE WHEN stddev_samp(value) OVER f = 0 THEN 0 ELSE (value-avg(value) OVER f)/stddev_samp(value) OVER f END END AS z
  FROM {monthly} WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING)""", "z")
def _(t):
    return N.expanding_z(B.monthly(t), 24).select("date", "entity", "variable", "z")


@query("W10_expanding_z_population", """SELECT date, entity, variable, CASE WHEN stddev_pop(value) OVER f = 0 THEN 0
    ELSE (value-avg(value) OVER f)/stddev_pop(value) OVER f END AS z
  FROM {monthly} WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING)""", "z")
def _(t):
    return N.expanding_z_from_zero(B.monthly(t)).select("date", "entity", "variable", "z")


@query("W21_quantile_winsor", """SELECT date, entity, variable, greatest(least(value, hi), lo) AS value FROM {monthly}
  JOIN (SELECT date, variable, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM monthly GROUP BY 1,2)
  USING (date, variable)""", "value")
def _(t):
    return N.quantile_winsor(B.monthly(t), 0.05, 0.95).select("date", "entity", "variable", "value")


@query("P3_normalised_panel", """WITH cs AS (""" + CS_SQL + """), ts AS (SELECT date, entity, variable, CASE WHEN count(value) OVER f >= 24
    AND stddev_pop(value) OVER f > 0 THEN (value-avg(value) OVER f)/stddev_pop(value) OVER f END AS z FROM monthly
    WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS 59 PRECEDING)), raw AS (SELECT * FROM monthly)
  SELECT date, entity, z AS value, variable||'_CS' AS variable, 'ship' AS source, 'cs' AS normalization, variable AS base_variable,
   'generated' AS normalization_origin, NULL::INTEGER AS lookback_observations, 2::INTEGER AS min_observations FROM cs WHERE z IS NOT NULL
  UNION ALL SELECT date, entity, z, variable||'_TS', 'ship', 'ts', variable, 'generated', 60, 24 FROM ts WHERE z IS NOT NULL
  UNION ALL SELECT date, entity, value, variable, 'ship', NULL, NULL, NULL, NULL, NULL FROM raw""", "value")
def _(t):
    raw = B.monthly(t).withColumn("source", F.lit("ship"))
    return N.normalised_panel(raw).unionByName(raw, allowMissingColumns=True)


@query("F1_soft_band_weights", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY variable, date ORDER BY value DESC, entity)::DOUBLE
     / count(*) OVER (PARTITION BY variable, date) AS rp FROM {{monthly}}), w AS (SELECT *, {BAND} AS w0 FROM k)
  SELECT date, entity, variable, w0/sum(w0) OVER (PARTITION BY variable, date) AS weight FROM w WHERE w0 > 0""", "weight")
def _(t):
    return P.soft_band_weights(B.monthly(t)).select("date", "entity", "variable", "weight")


def _signal(t):
    return N.cross_z(B.monthly(t)).select("date", "entity", "variable", F.col("z").alias("value"))


@query("F2_net_portfolio_return", f"""WITH {MEMBERS_SQL}
  SELECT variable, date, sum(weight*ret) AS gross, count(*) AS held, any_value(bench) AS bench, sum(weight*ret) - any_value(bench) AS net
  FROM m JOIN bench USING (date) GROUP BY 1,2""", "gross bench net")
def _(t):
    return P.portfolio_returns(_signal(t), B.mret(t))


@query("F3_next_day_factor_returns", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY variable, date ORDER BY value DESC, entity)::DOUBLE
     / count(*) OVER (PARTITION BY variable, date) AS rp FROM {{daily}}), w AS (SELECT *, {BAND} AS w0 FROM k),
  m AS (SELECT *, w0/sum(w0) OVER (PARTITION BY variable, date) AS weight FROM w WHERE w0 > 0),
  cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM {{dret}})),
  nr AS (SELECT cal.date, entity, ret FROM cal JOIN dret ON dret.date = cal.nx),
  bench AS (SELECT date, avg(ret) AS bench FROM dret GROUP BY 1),
  g AS (SELECT variable, date, sum(weight*ret) AS gross FROM m LEFT JOIN nr USING (date, entity) GROUP BY 1,2)
  SELECT variable, date, gross, coalesce(gross-bench, 0) AS net FROM g JOIN bench USING (date)""", "gross net")
def _(t):
    r = B.dret(t)
    bench = r.groupBy("date").agg(F.avg("ret").alias("bench"))
    return P.next_day_factor_returns(B.daily(t), r, bench).select("variable", "date", "gross", "net")


@query("F4_row_mean_fill_trailing", f"""WITH {MEMBERS_SQL}, n AS (SELECT variable, date, sum(weight*ret) - any_value(bench) AS net
    FROM m JOIN bench USING (date) WHERE NOT (variable='A' AND month(date)=3) GROUP BY 1,2),
   g AS (SELECT d.date, v.variable, coalesce(n.net, d.a) AS net FROM (SELECT date, avg(net) AS a FROM n GROUP BY 1) d
     CROSS JOIN (SELECT DISTINCT variable FROM n) v LEFT JOIN n ON n.date=d.date AND n.variable=v.variable)
  SELECT date, variable, net, avg(net) OVER (PARTITION BY variable ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS trail FROM g""",
  "net trail")
def _(t):
    net = P.portfolio_returns(_signal(t), B.mret(t)).filter(~((F.col("variable") == "A") & (F.month("date") == 3)))
    return P.trailing_mean(P.fill_with_row_mean(net)).select("date", "variable", "net", F.col("trailing").alias("trail"))


def _contrib(t):
    return P.factor_contributions(_signal(t), B.mret(t), "ship")


CONTRIB_SQL = f"""WITH {MEMBERS_SQL}, n AS (SELECT variable, date, sum(weight*ret) - any_value(bench) AS net
    FROM m JOIN bench USING (date) GROUP BY 1,2),
   c AS (SELECT m.date, m.entity, m.variable AS factor, m.weight, 'ship' AS source, n.net AS factor_return, m.weight*n.net AS contribution
     FROM m JOIN n USING (variable, date))"""


@query("J1_contribution_join", CONTRIB_SQL + " SELECT * FROM c", "weight factor_return contribution")
def _(t):
    return _contrib(t)


@query("F5_attribution_by_magnitude", CONTRIB_SQL + """ SELECT entity, factor, sum(contribution) AS contribution, count(*) AS periods
   FROM c GROUP BY 1,2 ORDER BY abs(sum(contribution)) DESC, entity, factor LIMIT 20""", "contribution")
def _(t):
    return P.attribution(_contrib(t), by_magnitude=True, n=20)


@query("flagship_attribution", CONTRIB_SQL + """ SELECT entity, factor, sum(contribution) AS contribution, count(*) AS periods
   FROM c GROUP BY 1,2""", "contribution")
def _(t):
    return P.attribution(_contrib(t), by_magnitude=False)


LEGS_SQL = """p AS (SELECT s.date, s.entity, (rank() OVER g2 + (count(*) OVER (PARTITION BY date, value)-1)/2.0)/count(*) OVER g AS pct
    FROM {sales} s WINDOW g AS (PARTITION BY date), g2 AS (PARTITION BY date ORDER BY value)),
  sd AS (SELECT *, CASE WHEN pct <= 0.2 THEN 1 WHEN pct >= 0.8 THEN -1 END AS side FROM p),
  c AS (SELECT date, count(*) n, count(*) FILTER (side=1) l, count(*) FILTER (side=-1) s FROM sd GROUP BY 1 HAVING n>=8 AND l>0 AND s>0),
  w AS (SELECT date, entity, CASE WHEN side=1 THEN 1.0/l ELSE -1.0/s END AS weight FROM sd JOIN c USING (date) WHERE side IS NOT NULL)"""


def _legs(t):
    pct = N.percent_rank_average(B.sales(t), ("date",))
    return P.quantile_legs(pct, "pct", 0.2, 0.8, long_low=True).select("date", "entity", "weight")


@query("F6_quantile_legs", "WITH " + LEGS_SQL + " SELECT * FROM w", "weight")
def _(t):
    return _legs(t)


EVAL_SQL = LEGS_SQL + """, cal AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM w)),
  pr AS (SELECT cal.date, w.entity, w.weight AS w0 FROM cal JOIN w ON w.date = cal.prev),
  tv AS (SELECT coalesce(w.date, pr.date) AS date, sum(abs(coalesce(w.weight,0)-coalesce(w0,0))) AS turnover
     FROM w FULL JOIN pr ON w.date=pr.date AND w.entity=pr.entity GROUP BY 1),
  gr AS (SELECT date, sum(weight*coalesce(ret,0)) AS gross, sum(CASE WHEN weight>0 THEN weight ELSE 0 END) AS long_exposure,
     sum(CASE WHEN weight<0 THEN weight ELSE 0 END) AS short_exposure, count(*) AS positions FROM w LEFT JOIN {mret} USING (date, entity) GROUP BY 1),
  ev AS (SELECT gr.*, turnover, cost_bps::DOUBLE AS cost_bps, gross - turnover*cost_bps/1e4 AS net FROM gr JOIN tv USING (date), (SELECT unnest([0,10,25,50]) AS cost_bps))"""


@query("F7_evaluate_weights", "WITH " + EVAL_SQL + " SELECT * FROM ev", "gross long_exposure short_exposure turnover net")
def _(t):
    return P.evaluate_weights(_legs(t), B.mret(t))


@query("F7_performance_summary", "WITH " + EVAL_SQL + """, lv AS (SELECT cost_bps, net, date, exp(sum(ln(1+net)) OVER (PARTITION BY cost_bps ORDER BY date)) AS lvl FROM ev),
  dd AS (SELECT *, lvl/greatest(1, max(lvl) OVER (PARTITION BY cost_bps ORDER BY date)) - 1 AS dd FROM lv)
  SELECT cost_bps, count(net) AS n_obs, avg(net)*12 AS ann_mean, stddev_samp(net)*sqrt(12) AS ann_vol, avg(net)/stddev_samp(net)*sqrt(12) AS sharpe,
   exp(sum(ln(1+net))*12/count(net))-1 AS ann_return, avg((net>0)::INT::DOUBLE) AS hit_rate, min(dd) AS max_drawdown FROM dd GROUP BY 1""",
   "ann_mean ann_vol sharpe ann_return hit_rate max_drawdown")
def _(t):
    return P.performance(P.evaluate_weights(_legs(t), B.mret(t)), ["cost_bps"])


@query("F11_equal_weight_baseline", """WITH b AS (SELECT date, avg(ret) AS net FROM {mret} GROUP BY 1),
  lv AS (SELECT *, exp(sum(ln(1+net)) OVER (ORDER BY date)) AS lvl FROM b), dd AS (SELECT *, lvl/greatest(1,max(lvl) OVER (ORDER BY date))-1 AS dd FROM lv)
  SELECT 'EW' AS book, count(net) AS n_obs, avg(net)*12 AS ann_mean, stddev_samp(net)*sqrt(12) AS ann_vol, avg(net)/stddev_samp(net)*sqrt(12) AS sharpe,
   exp(sum(ln(1+net))*12/count(net))-1 AS ann_return, avg((net>0)::INT::DOUBLE) AS hit_rate, min(dd) AS max_drawdown FROM dd""",
   "ann_mean ann_vol sharpe ann_return hit_rate max_drawdown")
def _(t):
    return P.performance(P.equal_weight_baseline(B.mret(t)).withColumn("book", F.lit("EW")), ["book"])
