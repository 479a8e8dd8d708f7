"""Window feature queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import normalise as N
from . import base as B
from .base import query

EV = "(PARTITION BY entity, variable ORDER BY date)"


def steps(t):
    """Monthly revenue in whole millions, so that values repeat."""
    return B.monthly(t).withColumn("value", F.round(F.col("value") / 1e6, 0))


STEPS = "(SELECT date, entity, variable, round(value/1e6, 0) + 0.0 AS value FROM {monthly})"


@query("W11_real_changes", f"""SELECT date, entity, variable, value FROM (SELECT *, lag(value) OVER {EV} AS p, row_number() OVER {EV} AS r
   FROM {STEPS}) WHERE r = 1 OR value IS DISTINCT FROM p""", "value")
def _(t):
    return X.real_changes(steps(t))


@query("W12_last_z", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY date DESC) AS r,
     count(*) OVER (PARTITION BY entity, variable) AS n FROM {monthly})
  SELECT entity, variable, max(date) AS date, max(value) FILTER (r=1) AS last_value, count(*) AS n_window,
     (max(value) FILTER (r=1) - avg(value))/stddev_samp(value) AS z FROM r WHERE r <= 36 AND n >= 24 GROUP BY 1,2""", "last_value z")
def _(t):
    return X.last_z(B.monthly(t), 36, 24)


@query("W13_trailing_return", """SELECT date, entity, CASE WHEN count(ret) OVER f >= 21 THEN exp(sum(ln(1+ret)) OVER f)-1 END AS trail
   FROM {dret} WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING)""", "trail")
def _(t):
    return X.trailing_return(B.dret(t), 21, out="trail").select("date", "entity", "trail")


@query("W13_trailing_return_on_calendar", """WITH tr AS (SELECT date, entity, exp(sum(ln(1+ret)) OVER f)-1 AS trail, count(*) OVER f AS c
     FROM {dret} WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 4 PRECEDING)),
   cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM dret)),
   p AS (SELECT entity, i, CASE WHEN c>=5 THEN trail END AS trail, lead(i) OVER (PARTITION BY entity ORDER BY i) AS nx FROM tr JOIN cal USING (date))
   SELECT cal.date, entity, trail FROM p JOIN cal ON cal.i >= p.i AND cal.i <= p.i+5 AND (nx IS NULL OR cal.i < nx)""", "trail")
def _(t):
    return X.on_calendar(X.trailing_return(B.dret(t), 5, out="trail"), 5, values=["trail"])


@query("W14_shifted_returns", f"""SELECT date, entity, lead(value,3) OVER {EV}/value-1 AS fwd_3, value/lag(value,12) OVER {EV}-1 AS back_12,
   value/lag(value,12) OVER {EV} - value/lag(value,1) OVER {EV} AS spread FROM {{sales}}""", "fwd_3 back_12 spread")
def _(t):
    d = X.shifted_return(B.sales(t), 3, True, out="fwd_3")
    d = X.shifted_return(X.shifted_return(d, 12, out="back_12"), 1, out="_b1")
    return d.select("date", "entity", "fwd_3", "back_12", (F.col("back_12") - F.col("_b1")).alias("spread"))


@query("W15_change_and_ma_ratio", f"""SELECT date, entity, variable, value - lag(value,6) OVER {EV} AS diff, value/lag(value,6) OVER {EV}-1 AS rel,
   CASE WHEN count(value) OVER f >= 12 THEN value/avg(value) OVER f END AS ma_ratio FROM {{monthly}}
   WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS 11 PRECEDING)""", "diff rel ma_ratio")
def _(t):
    d = X.change(X.change(B.monthly(t), 6, True, out="diff"), 6, False, out="rel")
    return X.moving_average_ratio(d, 12).drop("value")


@query("W16_calendar_delta", """SELECT a.date, a.entity, a.variable, a.value - b.value AS delta FROM {monthly} a LEFT JOIN monthly b
   ON a.entity=b.entity AND a.variable=b.variable AND b.date = CAST(a.date - INTERVAL 12 MONTH AS DATE)""", "delta")
def _(t):
    return X.calendar_delta(B.monthly(t)).drop("value")


GAPPY = "(SELECT date, entity, variable, CASE WHEN month(date) IN (2,3,4,5,9) THEN NULL ELSE value END AS value FROM {monthly})"


@query("W17_forward_fill", f"""SELECT date, entity, variable, last_value(value IGNORE NULLS) OVER (PARTITION BY entity, variable ORDER BY date ROWS 2 PRECEDING) AS v2,
   last_value(value IGNORE NULLS) OVER (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING) AS vall FROM {GAPPY}""", "v2 vall")
def _(t):
    gappy = B.monthly(t).withColumn("value", F.when(~F.month("date").isin(2, 3, 4, 5, 9), F.col("value")))
    d = X.forward_fill(gappy, 2, out="v2")
    return X.forward_fill(d, None, out="vall").drop("value")


@query("W18_expand_monthly", """WITH q AS (SELECT * FROM {monthly} WHERE (variable='A' AND month(date)%3=1) OR (variable='N' AND month(date)=1) OR variable='R'),
   g AS (SELECT variable, quantile_cont(gap,0.5) AS mg, count(*) AS n FROM (SELECT variable, date, date - lag(date) OVER (PARTITION BY variable ORDER BY date) AS gap
      FROM (SELECT DISTINCT variable, date FROM q)) GROUP BY 1),
   f AS (SELECT variable, CASE WHEN n<3 THEN 'sparse' WHEN mg<=45 THEN 'monthly' WHEN mg<=140 THEN 'quarterly' WHEN mg<=430 THEN 'annual' ELSE 'sparse' END AS frequency FROM g),
   l AS (SELECT *, CASE frequency WHEN 'monthly' THEN 2 WHEN 'quarterly' THEN 4 WHEN 'annual' THEN 15 ELSE 0 END AS lim FROM f),
   e AS (SELECT variable, max(date) AS vmax FROM q GROUP BY 1),
   d AS (SELECT q.*, frequency, lim, vmax, lead(date) OVER (PARTITION BY entity, q.variable ORDER BY date) AS nx FROM q JOIN l USING (variable) JOIN e USING (variable))
   SELECT entity, variable, CAST(date + to_months(k::INT) AS DATE) AS date, value, frequency FROM d, (SELECT unnest(range(0,16)) AS k)
   WHERE k <= lim AND (nx IS NULL OR CAST(date + to_months(k::INT) AS DATE) < nx) AND (k = 0 OR CAST(date + to_months(k::INT) AS DATE) <= vmax)""", "value")
def _(t):
    m, v = F.month("date"), F.col("variable")
    return X.expand_monthly(
        B.monthly(t).filter(((v == "A") & (m % 3 == 1)) | ((v == "N") & (m == 1)) | (v == "R"))
    )


@query("W19_rolling_mad_winsor", """WITH a AS (SELECT *, CASE WHEN count(value) OVER f >= 24 THEN quantile_cont(value,0.5) OVER f END AS med FROM {monthly}
     WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS 59 PRECEDING)),
   b AS (SELECT *, abs(value-med) AS dev FROM a),
   c AS (SELECT *, CASE WHEN count(dev) OVER f >= 24 THEN quantile_cont(dev,0.5) OVER f END*1.4826 AS mad FROM b
     WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS 59 PRECEDING))
   SELECT date, entity, variable, CASE WHEN mad > 0 THEN greatest(least(value, med+2*mad), med-2*mad) ELSE value END AS value FROM c""", "value")
def _(t):
    return X.rolling_mad_winsor(B.monthly(t), 60, 24, 2.0)


@query("W20_full_mad_winsor", """WITH m AS (SELECT entity, variable, quantile_cont(value,0.5) AS med FROM {monthly} GROUP BY 1,2),
   d AS (SELECT entity, variable, quantile_cont(abs(value-med),0.5) AS mad FROM monthly JOIN m USING (entity, variable) GROUP BY 1,2)
   SELECT date, entity, variable, greatest(least(value, med+2*1.4826*mad), med-2*1.4826*mad) AS value FROM monthly JOIN m USING (entity, variable) JOIN d USING (entity, variable)""", "value")
def _(t):
    return X.full_mad_winsor(B.monthly(t), 2.0)


@query("W22_ewm_mean", """SELECT date, entity, variable, list_reduce(array_agg(value) OVER (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING),
    lambda a, x: a*(1-2.0/8) + x*2.0/8) AS fast FROM {monthly}""", "fast", digits=4)
def _(t):
    return X.ewm_mean(B.monthly(t), {"fast": ("value", 7)}).drop("value")


@query("W22_ewm_outlier_replace")
def _(t):
    return X.ewm_outlier_replace(B.daily(t))


@query("P23_sheet_cleaned_level")
def _(t):
    return X.sheet_cleaned(B.monthly(t))


@query("P23_sheet_cleaned_two_sided", """WITH f AS (SELECT date, entity, variable, last_value(value IGNORE NULLS) OVER (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM {monthly}),
   m AS (SELECT entity, variable, quantile_cont(value,0.5) AS med FROM f GROUP BY 1,2), d AS (SELECT entity, variable, quantile_cont(abs(value-med),0.5)*5*1.4826 AS r FROM f JOIN m USING (entity, variable) GROUP BY 1,2),
   c AS (SELECT date, entity, variable, greatest(least(value, med+r), med-r) AS value FROM f JOIN m USING (entity, variable) JOIN d USING (entity, variable)),
   n AS (SELECT *, list_concat(coalesce(array_agg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []), coalesce(array_agg(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), [])) AS near FROM c WINDOW w AS (PARTITION BY entity, variable ORDER BY date)),
   g AS (SELECT *, list_transform(range(len(near)), lambda i: pow(19.0/21, len(near)-1-i)) AS w FROM n),
   h AS (SELECT *, list_sum(w) AS w1, list_sum(list_transform(w, lambda x: x*x)) AS w2, list_sum(list_transform(list_zip(w, near), lambda z: z[1]*z[2]))/list_sum(w) AS mu FROM g),
   k AS (SELECT *, sqrt(list_sum(list_transform(list_zip(w, near), lambda z: z[1]*pow(z[2]-mu, 2)))/(w1-w2/w1)) AS sd FROM h)
   SELECT date, entity, variable, value, CASE WHEN len(near) >= 10 AND sd > 2.3e-16 AND abs(value-mu) > 4*sd THEN mu ELSE value END AS value_clean FROM k""", "value value_clean", digits=5)
def _(t):
    return X.sheet_cleaned(B.monthly(t), trailing=False)


@query("W23_rolling_percentile", """WITH h AS (SELECT *, array_agg(value) OVER (PARTITION BY entity, variable ORDER BY date ROWS 35 PRECEDING) AS h FROM {monthly})
   SELECT date, entity, variable, CASE WHEN len(h) >= 12 THEN len(list_filter(h, lambda v: v <= value))*100.0/len(h) END AS pct FROM h""", "pct")
def _(t):
    return X.rolling_percentile(B.monthly(t), 36, 12).drop("value")


@query("W24_expanding_percentile_prior", """WITH h AS (SELECT *, array_agg(value) OVER (PARTITION BY entity, variable ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {monthly})
   SELECT date, entity, variable, CASE WHEN len(h) >= 24 THEN len(list_filter(h, lambda v: v <= value))*1.0/len(h) END AS pct FROM h""", "pct")
def _(t):
    return X.expanding_percentile(B.monthly(t)).drop("value")


@query("W24_expanding_percentile_inclusive", f"""WITH h AS (SELECT *, array_agg(value) OVER (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING) AS h FROM {STEPS})
   SELECT date, entity, variable, CASE WHEN len(h) >= 24 THEN (len(list_filter(h, lambda v: v <= value))+len(list_filter(h, lambda v: v < value)))/2.0/len(h) END AS pct FROM h""", "pct")
def _(t):
    return X.expanding_percentile(steps(t), inclusive=True).drop("value")


@query("W25_pit_buckets", """WITH h AS (SELECT *, quantile_cont(value,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) OVER f AS q, count(value) OVER f AS c FROM {monthly}
     WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING))
   SELECT date, entity, variable, CASE WHEN c >= 36 THEN 1 + len(list_filter(q, lambda x: x < value)) END AS bucket FROM h""")
def _(t):
    return X.pit_buckets(B.monthly(t)).drop("value")


@query("W26_full_sample_buckets", """SELECT date, entity, variable, 1 + len(list_filter(q, lambda x: x < value)) AS bucket FROM {monthly} JOIN
   (SELECT entity, variable, quantile_cont(value,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM monthly GROUP BY 1,2) USING (entity, variable)""")
def _(t):
    return X.full_sample_buckets(B.monthly(t)).drop("value")


@query("W27_value_cut_terciles", """SELECT date, entity, 1 + len(list_filter(q, lambda x: x < value)) AS tile FROM {sales} JOIN
   (SELECT date, quantile_cont(value,[1.0/3,2.0/3]) AS q FROM sales GROUP BY 1) USING (date)""")
def _(t):
    return X.value_cut_groups(B.sales(t), 3).select("date", "entity", "tile")


@query("W28_rolling_abs_correlation", """WITH m AS (SELECT date, variable, sum(value) AS value FROM {monthly} GROUP BY 1,2),
   c AS (SELECT o.date, o.variable, CASE WHEN count(*) OVER f >= 6 THEN abs(corr(b.value, o.value) OVER f) END AS c FROM m o JOIN m b ON o.date=b.date AND b.variable='A'
     WHERE o.variable IN ('N','R') WINDOW f AS (PARTITION BY o.variable ORDER BY o.date ROWS 5 PRECEDING))
   SELECT date, avg(c) AS stress, count(c) AS n_pairs FROM c GROUP BY 1""", "stress")
def _(t):
    m = B.monthly(t).groupBy("date", "variable").agg(F.sum("value").alias("value"))
    return X.rolling_abs_correlation(m, "A", ["N", "R"])


def flow_input(t):
    return (
        t.lineitem.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("entity"))
        .agg(F.sum("l_quantity").alias("shares"), F.round(F.avg("l_tax"), 6).alias("nav"),
             F.round(F.sum("l_extendedprice"), 2).alias("aum"))
    )


@query("W29_flow_signals", """WITH i AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS entity, sum(l_quantity) AS shares, round(avg(l_tax),6) AS nav,
     round(sum(l_extendedprice),2) AS aum FROM lineitem GROUP BY 1,2),
   a AS (SELECT *, lag(shares) OVER (PARTITION BY entity ORDER BY date) AS p FROM i),
   b AS (SELECT *, CASE WHEN abs(shares-p)/p <= 0.5 THEN (shares-p)*nav END AS flow FROM a),
   c AS (SELECT *, CASE WHEN count(flow) OVER f >= 10 THEN sum(flow) OVER f END AS flow_sum FROM b WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING))
   SELECT date, entity, flow, flow_sum, flow_sum/aum*100 AS flow_pct_aum,
     CASE WHEN count(flow_sum) OVER z >= 120 AND stddev_samp(flow_sum) OVER z > 0 THEN (flow_sum-avg(flow_sum) OVER z)/stddev_samp(flow_sum) OVER z END AS flow_z
   FROM c WINDOW z AS (PARTITION BY entity ORDER BY date ROWS 251 PRECEDING)""", "flow flow_sum flow_pct_aum flow_z")
def _(t):
    return X.flow_signals(flow_input(t), 0.5, 21, 10).drop("shares", "nav", "aum")


@query("W30_drawdown", """WITH l AS (SELECT date, entity, exp(sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date)) AS lvl FROM {dret})
   SELECT date, entity, lvl/max(lvl) OVER (PARTITION BY entity ORDER BY date ROWS 251 PRECEDING)-1 AS dd252,
    lvl/max(lvl) OVER (PARTITION BY entity ORDER BY date)-1 AS dd_all FROM l""", "dd252 dd_all")
def _(t):
    d = X.drawdown(B.dret(t), 252, out="dd252")
    return X.drawdown(d, None, out="dd_all").drop("ret")


STATE = "(SELECT date, entity, CASE WHEN ret > 0.002 THEN 'up' WHEN ret < -0.002 THEN 'down' ELSE 'flat' END AS state FROM {mret})"


def states(t):
    return B.mret(t).withColumn("state", F.when(F.col("ret") > 0.002, "up").when(F.col("ret") < -0.002, "down").otherwise("flat")).drop("ret")


@query("W31_runs", f"""SELECT entity, state, min(date) AS start, max(date) AS "end", count(*) AS length FROM (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY date) AS run FROM
   (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY entity ORDER BY date) THEN 1 ELSE 0 END AS c FROM {STATE})) GROUP BY entity, run, state""")
def _(t):
    return X.runs(states(t))


@query("W31_transitions", f"""SELECT from_state, next_state, n, n*1.0/sum(n) OVER (PARTITION BY from_state) AS p FROM (SELECT state AS from_state, nx AS next_state, count(*) AS n FROM
   (SELECT *, lead(state) OVER (PARTITION BY entity ORDER BY date) AS nx FROM {STATE}) WHERE nx IS NOT NULL GROUP BY 1,2)""", "p")
def _(t):
    return X.transitions(states(t))


@query("W31_persistence", f"""WITH s AS (SELECT * FROM {STATE}), r AS (SELECT entity, count(*) AS length FROM (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY date) AS run FROM
    (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY entity ORDER BY date) THEN 1 ELSE 0 END AS c FROM s)) GROUP BY entity, run)
   SELECT entity, avg(p1) AS persist_1, avg(p3) AS persist_3, avg(p6) AS persist_6, any_value(md) AS mean_duration FROM (SELECT entity, (lead(state,1) OVER w = state)::INT AS p1, (lead(state,3) OVER w = state)::INT AS p3,
   (lead(state,6) OVER w = state)::INT AS p6 FROM s WINDOW w AS (PARTITION BY entity ORDER BY date)) JOIN (SELECT entity, avg(length) AS md FROM r GROUP BY 1) USING (entity) GROUP BY 1""",
   "persist_1 persist_3 persist_6 mean_duration")
def _(t):
    return X.persistence(states(t))


@query("W32_rising_edges", """WITH e AS (SELECT date, entity, ret, ret < -0.08 AS hit, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM {dret}),
   l AS (SELECT *, max(CASE WHEN hit THEN i END) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li FROM e)
   SELECT date, entity, ret FROM l WHERE hit AND i-1-coalesce(li,0) >= 20""", "ret")
def _(t):
    d = B.dret(t).withColumn("hit", F.col("ret") < -0.08)
    return X.rising_edges(d, "hit", 20).drop("hit")


def vintages(t):
    """Order totals by status as forecasts: vintage = order month, target = the year it counts for."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.trunc("o_orderdate", "month").alias("vintage"), F.col("c_mktsegment").alias("entity"),
                 F.col("o_orderstatus").alias("variable"),
                 (F.year("o_orderdate") + F.col("o_orderkey") % 2).cast("long").alias("target_year"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


VINT = """(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS vintage, c_mktsegment AS entity, o_orderstatus AS variable,
   year(o_orderdate) + o_orderkey % 2 AS target_year, round(sum(o_totalprice),2) AS value FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2,3,4)"""


@query("W33_vintage_revisions", f"""SELECT *, lag(value) OVER w AS prior_value, lag(vintage) OVER w AS prior_vintage, value - lag(value) OVER w AS revision FROM {VINT}
   WINDOW w AS (PARTITION BY entity, variable, target_year ORDER BY vintage)""", "value prior_value revision")
def _(t):
    return X.vintage_revisions(vintages(t))


REV = f"""rev AS (SELECT vintage AS month, entity, variable, target_year, value AS consensus, value-lag(value,1) OVER w AS rev_1m, value-lag(value,3) OVER w AS rev_3m,
    count(*) OVER (PARTITION BY entity, variable, target_year) AS n FROM {VINT} WINDOW w AS (PARTITION BY entity, variable, target_year ORDER BY vintage))"""


@query("W34_consensus_revisions", f"WITH {REV} SELECT * EXCLUDE (n) FROM rev WHERE n >= 2", "consensus rev_1m rev_3m")
def _(t):
    return X.consensus_revisions(vintages(t).withColumnRenamed("vintage", "date"))


@query("W34_fixed_horizon_blend", f"""WITH {REV} SELECT month, entity, variable, (12-month(month))/12.0*a.rev_3m + (1-(12-month(month))/12.0)*b.rev_3m AS value
   FROM (SELECT * FROM rev WHERE n>=2 AND target_year = year(month)) a JOIN (SELECT * FROM rev WHERE n>=2 AND target_year = year(month)+1) b USING (month, entity, variable)
   WHERE a.rev_3m IS NOT NULL AND b.rev_3m IS NOT NULL""", "value")
def _(t):
    return X.fixed_horizon_blend(X.consensus_revisions(vintages(t).withColumnRenamed("vintage", "date")))


@query("W35_level_change_events", f"""SELECT * FROM (SELECT date, entity, variable AS agency, value AS score, lag(value) OVER {EV} AS prior_score, value - lag(value) OVER {EV} AS delta FROM {STEPS})
   WHERE delta <> 0""", "score prior_score delta")
def _(t):
    return X.level_change_events(steps(t).select("date", "entity", F.col("variable").alias("agency"), F.col("value").alias("score")))


@query("W36_commodity_features", """WITH m AS (SELECT *, (value/lag(value) OVER w - 1)*100 AS mom_pct, (value/lag(value,12) OVER w - 1)*100 AS yoy_pct, (value/lag(value,3) OVER w - 1)*100 AS ret_3m_pct
    FROM {sales} WINDOW w AS (PARTITION BY entity ORDER BY date)),
   f AS (SELECT *, yoy_pct AS ret_12m_pct, value AS level, CASE WHEN count(mom_pct) OVER a >= 6 THEN stddev_pop(mom_pct) OVER a END AS vol_12m,
     CASE WHEN count(value) OVER b >= 12 AND stddev_pop(value) OVER b > 0 THEN (value-avg(value) OVER b)/stddev_pop(value) OVER b END AS z_36m FROM m
     WINDOW a AS (PARTITION BY entity ORDER BY date ROWS 11 PRECEDING), b AS (PARTITION BY entity ORDER BY date ROWS 35 PRECEDING))
   SELECT entity, date, feature, value FROM (SELECT entity, date, level, mom_pct, yoy_pct, ret_3m_pct, ret_12m_pct, vol_12m, z_36m FROM f)
    UNPIVOT (value FOR feature IN (level, mom_pct, yoy_pct, ret_3m_pct, ret_12m_pct, vol_12m, z_36m))""", "value")
def _(t):
    return X.commodity_features(B.sales(t))


@query("W37_price_to_peak", f"""WITH x AS (SELECT *, row_number() OVER {EV}::DOUBLE AS x FROM {{monthly}})
   SELECT date, entity, variable, CASE WHEN count(value) OVER f = 13 THEN value/max(value) OVER g * regr_r2(value, x) OVER f * CASE WHEN regr_slope(value, x) OVER f > 0 THEN 1 ELSE -1 END END AS score
   FROM x WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS 12 PRECEDING), g AS (PARTITION BY entity, variable ORDER BY date ROWS 11 PRECEDING)""", "score")
def _(t):
    return X.price_to_peak(B.monthly(t)).drop("value")


def instrument(t):
    return (
        t.lineitem.join(B.supplier_nation(t), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.to_date("l_shipdate").alias("date"), "entity")
        .agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 8).alias("close"), F.sum("l_quantity").alias("volume"))
    )


@query("W38_price_state", """WITH px AS (SELECT CAST(l_shipdate AS DATE) AS date, n_name AS entity, round(sum(l_extendedprice)/sum(l_quantity),8) AS close, sum(l_quantity) AS volume
     FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY 1,2),
   rr AS (SELECT date, entity, CASE WHEN count(*) OVER a=5 THEN exp(sum(ln(1+ret)) OVER a)-1 END AS ret_5, CASE WHEN count(*) OVER b=21 THEN exp(sum(ln(1+ret)) OVER b)-1 END AS ret_21,
     CASE WHEN count(*) OVER c=63 THEN exp(sum(ln(1+ret)) OVER c)-1 END AS ret_63 FROM {dret}
     WINDOW a AS (PARTITION BY entity ORDER BY date ROWS 4 PRECEDING), b AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING), c AS (PARTITION BY entity ORDER BY date ROWS 62 PRECEDING)),
   st AS (SELECT entity, max(date) AS return_date, arg_max(ret_5,date) AS ret_5, arg_max(ret_21,date) AS ret_21, arg_max(ret_63,date) AS ret_63 FROM rr GROUP BY 1),
   z AS (SELECT entity, (max(ret_21) FILTER (r=1)-avg(ret_21))/stddev_samp(ret_21) AS ret_21_z FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY entity) AS n
      FROM rr WHERE ret_21 IS NOT NULL) WHERE r<=756 AND n>=252 GROUP BY 1),
   pp AS (SELECT date, entity, close/lag(close,1) OVER w-1 AS px_1, close/lag(close,5) OVER w-1 AS px_5, close/lag(close,21) OVER w-1 AS px_21, close/lag(close,63) OVER w-1 AS px_63,
     avg(close*volume) OVER (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING) AS adv_21 FROM px WINDOW w AS (PARTITION BY entity ORDER BY date)),
   ins AS (SELECT entity, max(date) AS price_date, arg_max(px_5,date) AS px_5, arg_max(px_21,date) AS px_21, arg_max(px_63,date) AS px_63, arg_max(adv_21,date) AS adv_21 FROM pp GROUP BY 1),
   g AS (SELECT date, entity, CASE WHEN count(*) OVER f = 21 THEN sum(px_1-ret) OVER f END AS v FROM pp JOIN dret USING (date, entity) WHERE px_1 IS NOT NULL WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING)),
   gz AS (SELECT entity, (max(v) FILTER (r=1)-avg(v))/stddev_samp(v) AS basis_z FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY entity) AS n
      FROM g WHERE v IS NOT NULL) WHERE r<=756 AND n>=61 GROUP BY 1)
   SELECT *, px_5-ret_5 AS basis_5, px_21-ret_21 AS basis_21, CASE WHEN adv_21 IS NULL THEN 'missing' WHEN adv_21>=5e7 THEN 'high' WHEN adv_21>=1e7 THEN 'medium' WHEN adv_21>=1e6 THEN 'low' ELSE 'micro' END AS liquidity
   FROM st LEFT JOIN z USING (entity) LEFT JOIN ins USING (entity) LEFT JOIN gz USING (entity)""",
   "ret_5 ret_21 ret_63 ret_21_z px_5 px_21 px_63 adv_21 basis_z basis_5 basis_21")
def _(t):
    return X.price_state(B.dret(t), instrument(t))


@query("W39_spread_signals", """WITH l AS (SELECT date, entity, max(value) FILTER (variable='A') AS a, max(value) FILTER (variable='R') AS b FROM {monthly} GROUP BY 1,2),
   s AS (SELECT date, entity, a-b AS value, 'SLOPE' AS variable FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT date, entity, a/b, 'TERM' FROM l WHERE a IS NOT NULL AND b IS NOT NULL
     UNION ALL SELECT date, entity, (a/b-1)*100, 'CURVE' FROM l WHERE a>0 AND b>0)
   SELECT date, entity, variable, value, CASE WHEN count(value) OVER f >= 12 AND stddev_samp(value) OVER f > 0 THEN (value-avg(value) OVER f)/stddev_samp(value) OVER f END AS z
   FROM s WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)""", "value z")
def _(t):
    m = B.monthly(t)
    s = X.two_leg_spread(m, "A", "R", "SLOPE").unionByName(X.two_leg_spread(m, "A", "R", "TERM", "ratio")).unionByName(
        X.two_leg_spread(m, "A", "R", "CURVE", "curve"))
    return N.rolling_z(s, 36, 12, ddof=1, prior=True)


@query("W40_weekly_position_z", """WITH w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS date, entity, arg_max(value, date) AS value FROM {daily} GROUP BY 1,2)
   SELECT date, entity, CASE WHEN count(value) OVER f >= 52 AND stddev_samp(value) OVER f > 0 THEN (value-avg(value) OVER f)/stddev_samp(value) OVER f END AS z FROM w
   WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 155 PRECEDING)""", "z")
def _(t):
    w = B.daily(t).groupBy(F.to_date(F.date_trunc("week", "date")).alias("date"), "entity").agg(F.max_by("value", "date").alias("value"))
    return N.rolling_z(w, 156, 52, ("entity",), ddof=1).select("date", "entity", "z")


@query("W43_default_probability", """SELECT date, entity, 1-exp(-value/1e6/10000*5.0/0.6) AS p5 FROM {sales}""", "p5")
def _(t):
    return B.sales(t).select("date", "entity", X.default_probability(F.col("value") / 1e6).alias("p5"))


@query("W45_interval_membership", """WITH i AS (SELECT n_name AS entity, r_regionkey, CASE WHEN r_regionkey=0 THEN DATE '1996-01-01' ELSE DATE '1997-06-01' END AS s, CASE WHEN r_regionkey=0 THEN DATE '2099-01-01' ELSE DATE '1999-12-31' END AS e,
     CASE WHEN r_regionkey=0 THEN 100.0 ELSE 75.0 END AS v FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_regionkey IN (0,1))
   SELECT date, sales.entity, coalesce(max(v),0.0) AS value FROM {sales} LEFT JOIN i ON i.entity=sales.entity AND date BETWEEN s AND e GROUP BY 1,2""", "value")
def _(t):
    standing = F.col("n_regionkey") == 0
    i = t.nation.filter(F.col("n_regionkey").isin(0, 1)).select(
        F.col("n_name").alias("entity"),
        F.when(standing, F.lit("1996-01-01")).otherwise("1997-06-01").cast("date").alias("start"),
        F.when(standing, F.lit("2099-01-01")).otherwise("1999-12-31").cast("date").alias("end"),
        F.when(standing, 100.0).otherwise(75.0).alias("value"),
    )
    return X.interval_membership(B.sales(t).select("date", "entity"), i)


@query("W46_macro_state", """WITH a AS (SELECT *, (value/lag(value,12) OVER w-1)*100 AS yoy, value/lag(value) OVER w-1 AS r, CASE WHEN count(value) OVER f=3 THEN avg(value) OVER f END AS u3 FROM {sales}
     WINDOW w AS (PARTITION BY entity ORDER BY date), f AS (PARTITION BY entity ORDER BY date ROWS 2 PRECEDING)),
   b AS (SELECT *, u3 - CASE WHEN count(u3) OVER g=12 THEN min(u3) OVER g END AS gap_from_low, CASE WHEN count(r) OVER f=3 THEN stddev_samp(r) OVER f END*sqrt(12)*100 AS vol_3m FROM a
     WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 2 PRECEDING), g AS (PARTITION BY entity ORDER BY date ROWS 11 PRECEDING))
   SELECT date, entity, yoy, gap_from_low, vol_3m, (gap_from_low>=0.5)::INT::DOUBLE AS triggered FROM b""", "yoy gap_from_low vol_3m triggered")
def _(t):
    return X.macro_state(B.sales(t)).drop("value", "variable")


@query("W47_three_leg_premium", """WITH m AS (SELECT * FROM {monthly} WHERE NOT (variable='R' AND month(date)%4<>1)),
   cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM m)),
   p AS (SELECT entity, variable, value, i, lead(i) OVER (PARTITION BY entity, variable ORDER BY i) AS nx FROM m JOIN cal USING (date)),
   x AS (SELECT entity, cal.date, max(value) FILTER (variable='A') a, max(value) FILTER (variable='N') b, max(value) FILTER (variable='R') c FROM p JOIN cal ON cal.i BETWEEN p.i AND p.i+3 AND (nx IS NULL OR cal.i<nx) GROUP BY 1,2)
   SELECT date, entity, a-(b-c) AS value, 'ERP' AS variable FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""", "value")
def _(t):
    m = B.monthly(t).filter(~((F.col("variable") == "R") & (F.month("date") % 4 != 1)))
    return X.three_leg_premium(m, "A", "N", "R", "ERP")


@query("A4_month_end_of_real_changes", f"""WITH d AS (SELECT date, entity, 'REV' AS variable, round(value/1e5,0)+0.0 AS value FROM {{daily}}),
   k AS (SELECT * FROM (SELECT *, lag(value) OVER {EV} AS p, row_number() OVER {EV} AS r FROM d) WHERE r=1 OR value IS DISTINCT FROM p)
   SELECT entity, variable, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(value,date) AS value, max(date) AS date FROM k GROUP BY 1,2,3""", "value")
def _(t):
    d = B.daily(t).withColumn("value", F.round(F.col("value") / 1e5, 0))
    return X.month_end_levels(d, ["entity", "variable"], only_changes=True)
