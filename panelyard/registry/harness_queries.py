"""Signal evaluation queries."""
import math

from pyspark.sql import functions as F

from ..operators.normalise import cross_z
from ..plans import harness as H
from . import base as B
from .base import query


def signals(t):
    """Each return flag's cross-sectional z as one signal."""
    return cross_z(B.monthly(t)).filter(F.col("z").isNotNull()).select(F.col("variable").alias("signal"), "date", "entity", F.col("z").alias("value"))


SIG = """s AS MATERIALIZED (SELECT variable AS signal, date, entity, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS value FROM {monthly} WINDOW g AS (PARTITION BY date, variable)),
  c AS (SELECT entity, year(date)*12+month(date) AS m, sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date) AS cum FROM {mret}),
  al AS MATERIALIZED (SELECT signal, date, s.entity, value, h AS horizon, exp(b.cum-a.cum)-1 AS fwd FROM s, (SELECT unnest([1,3,6])::INTEGER AS h) JOIN c a ON a.m = year(date)*12+month(date) JOIN c b ON b.m = a.m+h AND b.entity=a.entity WHERE a.entity=s.entity AND value IS NOT NULL)"""

IC = SIG + """, rk AS (SELECT *, rank() OVER x + (count(*) OVER (PARTITION BY signal,horizon,date,value)-1)/2.0 AS rx, rank() OVER y + (count(*) OVER (PARTITION BY signal,horizon,date,fwd)-1)/2.0 AS ry FROM al
    WINDOW x AS (PARTITION BY signal,horizon,date ORDER BY value), y AS (PARTITION BY signal,horizon,date ORDER BY fwd)),
  ic AS MATERIALIZED (SELECT signal, horizon, date, corr(rx,ry) AS ic, count(*) AS n_entities FROM rk GROUP BY 1,2,3 HAVING count(*)>=10 AND count(DISTINCT value)>=3)"""


@query("H1_align_monthly", f"WITH {SIG} SELECT signal, date, entity, value, horizon, fwd AS fwd_return FROM al", "value fwd_return")
def _(t):
    return H.align_monthly(signals(t), B.mret(t), [1, 3, 6])


def daily_signals(t):
    return B.daily(t).select(F.lit("REV").alias("signal"), "date", "entity", "value")


@query("H1_align_daily", """WITH c AS (SELECT entity, date, row_number() OVER w AS i, sum(ln(1+ret)) OVER w AS cum FROM {dret} WINDOW w AS (PARTITION BY entity ORDER BY date))
   SELECT 'REV' AS signal, d.date, d.entity, d.value, h::INTEGER AS horizon, exp(y.cum-c.cum)-1 AS fwd_return FROM {daily} d JOIN c ON c.entity=d.entity AND c.date=d.date, (SELECT unnest([5,21]) AS h) JOIN c y ON y.i=c.i+h WHERE y.entity=c.entity""", "value fwd_return", digits=4)
def _(t):
    return H.align_daily(daily_signals(t), B.dret(t), [5, 21])


@query("H2_rank_ic", f"WITH {IC} SELECT * FROM ic", "ic")
def _(t):
    return H.rank_ic(H.align_monthly(signals(t), B.mret(t), [1, 3, 6]))


NW = """e AS (SELECT signal, horizon, ic - avg(ic) OVER g AS e, count(*) OVER g AS n, avg(ic) OVER g AS mu, row_number() OVER (PARTITION BY signal,horizon ORDER BY date) AS i FROM ic WINDOW g AS (PARTITION BY signal,horizon)),
  gk AS (SELECT a.signal, a.horizon, k, any_value(a.n) AS n, any_value(a.mu) AS mu, sum(a.e*coalesce(b.e,0))/any_value(a.n) AS gam FROM e a CROSS JOIN (SELECT unnest(range(0,7)) AS k) LEFT JOIN e b ON b.signal=a.signal AND b.horizon=a.horizon AND b.i=a.i-k GROUP BY 1,2,3),
  nw AS (SELECT signal, horizon, any_value(mu) AS mean, any_value(n) AS n, any_value(mu)/sqrt(sum(CASE WHEN k=0 THEN gam WHEN k<=horizon THEN 2*(1-k/(horizon+1.0))*gam ELSE 0 END)/any_value(n)) AS nw_t FROM gk GROUP BY 1,2)"""


@query("H3_newey_west", f"WITH {IC}, {NW} SELECT * FROM nw", "mean nw_t")
def _(t):
    return H.newey_west(H.rank_ic(H.align_monthly(signals(t), B.mret(t), [1, 3, 6])), ["signal", "horizon"], "ic", "horizon", 6)


@query("H4_yearly_ic", f"WITH {IC} SELECT signal, horizon, year(date) AS year, round(avg(ic),4) AS mean_ic FROM ic GROUP BY 1,2,3", "mean_ic")
def _(t):
    return H.yearly_ic(H.rank_ic(H.align_monthly(signals(t), B.mret(t), [1, 3, 6])))


BT = SIG + """, o AS (SELECT signal, date, entity, fwd, row_number() OVER w AS p, count(*) OVER (PARTITION BY signal,date) AS n FROM al WHERE horizon=1 WINDOW w AS (PARTITION BY signal,date ORDER BY value DESC, entity)),
  kd AS (SELECT signal, date, avg(fwd) AS ret_ew, row_number() OVER (PARTITION BY signal ORDER BY date) AS k FROM o WHERE n>=14 GROUP BY 1,2),
  mb AS (SELECT o.*, k, CASE WHEN p<=7 THEN 1 WHEN p>n-7 THEN -1 END AS side FROM o JOIN kd USING (signal,date)), m2 AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY signal,entity,side ORDER BY k)=k-1, false) AS old FROM mb WHERE side IS NOT NULL),
  bt AS MATERIALIZED (SELECT m2.signal, m2.date, avg(fwd) FILTER (side=1) AS ret_top, avg(fwd) FILTER (side=-1) AS ret_bot, any_value(ret_ew) AS ret_ew, CASE WHEN any_value(m2.k)=1 THEN 1.0 ELSE count(*) FILTER (side=1 AND NOT old)/7.0 END AS turnover_top,
     CASE WHEN any_value(m2.k)=1 THEN 2.0 ELSE count(*) FILTER (NOT old)/7.0 END AS turnover_ls FROM m2 JOIN kd USING (signal,date) GROUP BY 1,2)"""


def bt(t):
    return H.backtest_monthly(H.align_monthly(signals(t), B.mret(t), [1]))


@query("H5_backtest_monthly", f"WITH {BT} SELECT * FROM bt", "ret_top ret_bot ret_ew turnover_top turnover_ls")
def _(t):
    return bt(t)


def _summary_sql(periods):
    b = f"(50.0/1e4/{periods})"
    ann = lambda x: f"round(exp(sum(ln(1+({x})))*{periods}/count({x}))-1,4)"
    sh = lambda x: f"round(avg({x})/stddev_samp({x})*sqrt({periods}),3)"
    ls = "ret_top-ret_bot"
    cols = ["count(*) AS n_periods", "min(date) AS start", 'max(date) AS "end"', "round(avg(turnover_top),5) AS turnover_top", "round(avg(turnover_ls),5) AS turnover_ls",
            f"round((avg({ls})-{b})/(2*avg(turnover_ls))*1e4,1) AS breakeven_bps", f"{ann('ret_top')} AS top_ann", f"{ann('ret_ew')} AS ew_ann", f"{ann(ls)} AS ls_ann", f"{sh(ls)} AS ls_sharpe", f"{sh('ret_top-ret_ew')} AS top_excess_sharpe"]
    for c in (5, 10, 25, 50):
        net = f"{ls}-turnover_ls*2*{c/1e4}-{b}"
        cols += [f"{ann(f'ret_top-turnover_top*2*{c/1e4}')}-{ann('ret_ew')} AS top_excess_net{c}", f"{ann(net)} AS ls_ann_net{c}", f"{sh(net)} AS ls_sharpe_net{c}"]
    return ", ".join(cols)


SUMF = "turnover_top turnover_ls breakeven_bps top_ann ew_ann ls_ann ls_sharpe top_excess_sharpe " + " ".join(f"top_excess_net{c} ls_ann_net{c} ls_sharpe_net{c}" for c in (5, 10, 25, 50))


@query("H5_H8_backtest_summary", f"WITH {BT} SELECT signal, {_summary_sql(12)} FROM bt GROUP BY 1", SUMF)
def _(t):
    return H.backtest_summary(bt(t))


TRANCHE = """sg AS (SELECT date, entity, value AS score FROM {daily}), cal AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM {dret})),
  o AS (SELECT date, entity, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS r, count(*) OVER (PARTITION BY date) AS n FROM sg),
  rd AS (SELECT date, (row_number() OVER (ORDER BY date)-1)%5 AS k FROM o WHERE n>=14 GROUP BY 1),
  rp AS (SELECT rd.date, k, p, lead(p) OVER (PARTITION BY k ORDER BY p) AS nx, row_number() OVER (PARTITION BY k ORDER BY p) AS sq FROM rd JOIN cal USING (date)),
  mb AS (SELECT o.date, entity, CASE WHEN r<=5 THEN 1 ELSE -1 END AS side FROM o WHERE n>=14 AND (r<=5 OR r>n-5)), m AS (SELECT mb.*, k, p, nx, sq FROM mb JOIN rp USING (date)),
  m2 AS (SELECT *, coalesce(lag(sq) OVER (PARTITION BY k,entity,side ORDER BY sq)=sq-1,false) AS old FROM m),
  tn AS (SELECT p, CASE WHEN any_value(sq)=1 THEN 1.0 ELSE count(*) FILTER (side=1 AND NOT old)/5.0 END/5 AS tt, CASE WHEN any_value(sq)=1 THEN 1.0 ELSE count(*) FILTER (side=-1 AND NOT old)/5.0 END/5 AS tb FROM m2 GROUP BY 1),
  rr AS (SELECT p, entity, ret FROM dret JOIN cal USING (date)),
  tr AS (SELECT rr.p, k, avg(ret) FILTER (side=1) AS t, count(*) FILTER (side=1) AS nt, avg(ret) FILTER (side=-1) AS b FROM m JOIN rr ON rr.entity=m.entity AND rr.p > m.p AND rr.p <= coalesce(m.nx, 1000000) GROUP BY 1,2 HAVING count(*) FILTER (side=1) >= 3),
  dy AS (SELECT p, avg(t) AS ret_top, avg(coalesce(b,0)) AS ret_bot FROM tr GROUP BY 1), ew AS (SELECT p, avg(ret) AS ret_ew FROM rr GROUP BY 1 HAVING count(*)>=10),
  bt AS MATERIALIZED (SELECT 'REV' AS signal, date, ret_top, ret_bot, ret_ew, coalesce(tt,0) AS turnover_top, coalesce(tt,0)+coalesce(tb,0) AS turnover_ls FROM dy JOIN ew USING (p) JOIN cal USING (p) LEFT JOIN tn USING (p))"""


@query("H6_backtest_daily_tranches", f"WITH {TRANCHE} SELECT * FROM bt", "ret_top ret_bot ret_ew turnover_top turnover_ls")
def _(t):
    return H.backtest_daily(daily_signals(t), B.dret(t), 5, n_top=5, min_ew=10)


@query("H7_hold_grid", f"WITH {TRANCHE} SELECT signal, 5::BIGINT AS hold, {_summary_sql(252)} FROM bt GROUP BY 1", SUMF)
def _(t):
    return H.hold_grid(daily_signals(t), B.dret(t), [5], n_top=5, min_ew=10)


SUBS = (("1995-1997", "1995-01-01", "1997-12-31"), ("1998-2001", "1998-01-01", "2001-12-31"))


@query("H7_subperiods", f"""WITH {BT} SELECT signal, CASE WHEN year(date)<=1997 THEN '1995-1997' ELSE '1998-2001' END AS subperiod, count(*) AS n_obs, CASE WHEN count(*)>=12 THEN round(exp(sum(ln(1+ret_top))*12/count(*))-1,4)-round(exp(sum(ln(1+ret_ew))*12/count(*))-1,4) END AS top_excess_ann,
   round(avg(ret_top-ret_bot)/stddev_samp(ret_top-ret_bot)*sqrt(12),3) AS ls_sharpe FROM bt GROUP BY 1,2""", "top_excess_ann ls_sharpe")
def _(t):
    return H.subperiod_table(bt(t), table=SUBS)


def _cdf(x):
    tt = f"(1/(1+0.2316419*abs({x})))"
    tail = f"(exp(-({x})*({x})/2)/sqrt(2*pi())*{tt}*(0.319381530+{tt}*(-0.356563782+{tt}*(1.781477937+{tt}*(-1.821255978+{tt}*1.330274429)))))"
    return f"CASE WHEN {x}>=0 THEN 1-{tail} ELSE {tail} END"


def _emax(n):
    from statistics import NormalDist
    z = NormalDist().inv_cdf
    return (1 - H.EULER_GAMMA) * z(1 - 1 / n) + H.EULER_GAMMA * z(1 - 1 / (n * math.e))


@query("H9_deflated_sharpe", f"""WITH {BT}, n AS (SELECT signal, ret_top-ret_bot-turnover_ls*2*0.0025-50.0/1e4/12 AS net FROM bt), mm AS (SELECT signal, avg(net) AS m, stddev_samp(net) AS s, stddev_pop(net) AS sp, count(*) AS n_obs FROM n GROUP BY 1),
   k AS (SELECT signal, any_value(m/s) AS sr, any_value(n_obs) AS n_obs, avg(((net-m)/sp)**3) AS k3, avg(((net-m)/sp)**4) AS k4 FROM n JOIN mm USING (signal) GROUP BY 1),
   f AS (SELECT *, sqrt(1.0/(n_obs-1))*{_emax(12)!r} AS em, sqrt(greatest(1-k3*sr+(k4-1)/4*sr**2,1e-9)) AS den FROM k), g AS (SELECT *, (sr-em)*sqrt(n_obs-1)/den AS x FROM f)
   SELECT signal, n_obs, round(sr,4) AS sharpe_per_period, round(sr*sqrt(12),3) AS sharpe_annualised, round(em,4) AS expected_max, round(sr-em,4) AS deflated_sharpe, round({_cdf('x')},4) AS prob_exceeds FROM g""",
   "sharpe_per_period sharpe_annualised expected_max deflated_sharpe prob_exceeds")
def _(t):
    return H.deflated_sharpe(H.net_series(bt(t)), ["signal"], "net", 12)


@query("H12_publication_lag", """WITH q AS (SELECT variable AS signal, date, entity FROM {monthly} WHERE variable='R' OR (variable='A' AND month(date)%3=1) OR (variable='N' AND month(date)=1)),
   g AS (SELECT signal, quantile_cont(gap,0.5) AS median_gap FROM (SELECT signal, date-lag(date) OVER (PARTITION BY signal,entity ORDER BY date) AS gap FROM q) GROUP BY 1)
   SELECT signal, median_gap, CASE WHEN median_gap<=45 THEN 1 WHEN median_gap<=135 THEN 3 ELSE 12 END::BIGINT AS lag_months FROM g""", "median_gap")
def _(t):
    m, v = F.month("date"), F.col("variable")
    q = B.monthly(t).filter((v == "R") | ((v == "A") & (m % 3 == 1)) | ((v == "N") & (m == 1)))
    return H.publication_lag(q.select(v.alias("signal"), "date", "entity", F.lit("ship").alias("source")), ["price"])


@query("H12_daily_lag", """SELECT DISTINCT event_type AS signal, event_type AS variable, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 2 ELSE 1 END::BIGINT AS lag_days FROM events""")
def _(t):
    e = F.col("event_type")
    s = t.events.select(e.alias("signal"), e.alias("variable"), F.when(e == "click", "price").otherwise("news").alias("source"))
    reg = s.select("variable").distinct().filter("variable in ('view','error')").withColumns({"status": F.when(F.col("variable") == "view", "passing").otherwise("failing"), "entitled_lag": F.lit(2)})
    return H.daily_lag(reg, s, ["price"])


VERDICT = """CASE WHEN coverage_fail THEN 'INSUFFICIENT_COVERAGE' WHEN history_fail THEN 'INSUFFICIENT_HISTORY' WHEN nw_t>=2.5 AND pct_years>=0.6 AND coalesce(ls_sharpe_net25>0 AND top_excess_net25>0 AND deflated_sharpe>0, false) THEN 'WATCH' WHEN nw_t>=1.5 THEN 'WEAK' ELSE 'DEAD' END"""
EVAL = f"""WITH {IC}, {NW.replace('range(0,7)', 'range(0,7)')}, y AS (SELECT signal, horizon, round(avg((m>0)::INT),3) AS py FROM (SELECT signal, horizon, year(date) AS yr, round(avg(ic),4) AS m FROM ic GROUP BY 1,2,3) GROUP BY 1,2),
  {BT[len(SIG)+2:].replace('>=14', '>=16').replace('<=7', '<=8').replace('n-7', 'n-8').replace('/7.0', '/8.0')},
  pf AS (SELECT signal, {_summary_sql(12)} FROM bt GROUP BY 1 HAVING count(*)>=24), nn AS (SELECT signal, ret_top-ret_bot-turnover_ls*2*0.0025-50.0/1e4/12 AS net FROM bt), ds AS (SELECT signal, round(avg(net)/stddev_samp(net)-sqrt(1.0/(count(*)-1))*{_emax(12)!r},4) AS deflated_sharpe FROM nn GROUP BY 1),
  cv AS (SELECT signal, avg((c>=20)::INT)<0.95 AS coverage_fail, count(*)<60 AS history_fail FROM (SELECT signal, date, count(DISTINCT entity) AS c FROM al WHERE horizon=1 GROUP BY 1,2) GROUP BY 1),
  j AS (SELECT cv.signal, round(nw.mean,4) AS mean_ic, round(nw.nw_t,3) AS nw_t, py AS pct_years, nw.n AS n_dates, coverage_fail, history_fail, ls_sharpe, ls_sharpe_net25, top_excess_net25, turnover_ls, deflated_sharpe FROM cv LEFT JOIN nw ON nw.signal=cv.signal AND nw.horizon=1 LEFT JOIN y ON y.signal=cv.signal AND y.horizon=1 LEFT JOIN pf ON pf.signal=cv.signal LEFT JOIN ds ON ds.signal=cv.signal)
  SELECT *, {VERDICT} AS verdict FROM j"""


@query("H13_H15_evaluate_sweep", EVAL, "mean_ic nw_t pct_years ls_sharpe ls_sharpe_net25 top_excess_net25 turnover_ls deflated_sharpe")
def _(t):
    return H.evaluate(signals(t), B.mret(t), [1, 3, 6], n_trials=12)


@query("H10_H17_reverdict", f"""WITH st AS (SELECT p_partkey AS signal, p_type AS family, 60+p_size AS n_obs, p_size/100.0 AS sharpe_per_period, p_size/12.0 AS nw_t, (p_size%10)/10.0 AS pct_years, p_retailprice-950 AS ls_sharpe_net25, 0.1 AS top_excess_net25 FROM part),
   tr AS (SELECT DISTINCT p_type AS family, 8::BIGINT AS n_trials FROM part), j AS (SELECT st.*, n_trials, round(sharpe_per_period-sqrt(1.0/(n_obs-1))*{_emax(8)!r},4) AS deflated_sharpe, false AS coverage_fail, false AS history_fail FROM st JOIN tr USING (family)) SELECT signal, family, n_obs::BIGINT AS n_obs, deflated_sharpe, {VERDICT} AS verdict FROM j""", "deflated_sharpe", digits=4)
def _(t):
    st = t.part.select(F.col("p_partkey").alias("signal"), F.col("p_type").alias("family"), (60 + F.col("p_size")).cast("long").alias("n_obs"), (F.col("p_size") / 100).alias("sharpe_per_period"), (F.col("p_size") / 12).alias("nw_t"),
                       ((F.col("p_size") % 10) / 10).alias("pct_years"), (F.col("p_retailprice") - 950).alias("ls_sharpe_net25"), F.lit(0.1).alias("top_excess_net25"))
    tr = t.part.select(F.col("p_type").alias("family")).distinct().withColumn("n_trials", F.lit(8).cast("long"))
    return H.reverdict(st, tr).select("signal", "family", "n_obs", "deflated_sharpe", "verdict")


@query("H14_ic_store", f"""WITH {IC}, f AS (SELECT signal||'-'||horizon::VARCHAR AS run_id, date, ic FROM ic) SELECT run_id, date, CASE WHEN run_id='A-1' THEN 0.5 ELSE ic END AS ic FROM f WHERE run_id<>'A-1' OR year(date)=1999""", "ic")
def _(t):
    ic = H.rank_ic(H.align_monthly(signals(t), B.mret(t), [1, 3, 6])).select(F.concat_ws("-", "signal", F.col("horizon").cast("string")).alias("run_id"), "date", "ic")
    fresh = ic.filter("run_id = 'A-1' AND year(date) = 1999").withColumn("ic", F.lit(0.5))
    return H.store_ic(ic, fresh)


@query("H16_spanning_r2", """WITH f AS (SELECT date, avg(ret) AS mkt FROM {mret} GROUP BY 1) SELECT entity, 'MKT' AS model, count(*) AS n_obs, regr_intercept(ret, mkt) AS alpha, regr_r2(ret, mkt) AS r2 FROM mret JOIN f USING (date) GROUP BY 1""", "alpha r2")
def _(t):
    r = B.mret(t)
    f = r.groupBy("date").agg(F.avg("ret").alias("value")).withColumn("factor", F.lit("MKT"))
    return H.spanning(r, f, {"MKT": ["MKT"]}).drop("alpha_t", "betas")


@query("H16_spanning_hac")
def _(t):
    r = B.mret(t)
    mkt = r.groupBy("date").agg(F.avg("ret").alias("value")).withColumn("factor", F.lit("MKT"))
    disp = r.groupBy("date").agg(F.stddev_samp("ret").alias("value")).withColumn("factor", F.lit("DISP"))
    return H.spanning(r, mkt.unionByName(disp), {"MKT": ["MKT"], "MKT2": ["MKT", "DISP"]})


@query("H11_load_signal", """SELECT 'H1' AS signal, date, entity, value, 'ship' AS source FROM {monthly} WHERE variable='N'""", "value", digits=4)
def _(t):
    p = B.monthly(t).withColumn("source", F.lit("ship"))
    return H.load_signal(p, "H1", "N")
