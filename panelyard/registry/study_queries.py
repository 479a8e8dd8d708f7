"""Conditional study queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import normalise as N
from ..plans import harness as H
from ..plans import studies as R
from . import base as B
from .base import query
from .harness_queries import IC, signals


def factor_panel(t):
    return B.monthly(t).select(F.col("variable").alias("factor"), "date", "entity", "value")


def records(t):
    return R.scan_records(factor_panel(t), B.mret(t), [1, 3])


REC = """p AS (SELECT variable AS factor, date, entity, value FROM {monthly}),
  sg AS MATERIALIZED (SELECT factor, date, entity, value, 'raw' AS normalization FROM p
    UNION ALL SELECT factor, date, entity, CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value-avg(value) OVER w)/stddev_pop(value) OVER w END, 'history_z' FROM p WINDOW w AS (PARTITION BY factor, entity ORDER BY date ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT factor, date, entity, CASE WHEN ps=0 THEN 0 ELSE (value-pm)/ps END, 'cross_z' FROM (SELECT *, sqrt(greatest(0,(s2-value*value)/(n-1)-pm*pm)) AS ps FROM (SELECT *, (s1-value)/(n-1) AS pm FROM (SELECT *, sum(value) OVER g AS s1, sum(value*value) OVER g AS s2, count(*) OVER g AS n FROM p WINDOW g AS (PARTITION BY factor, date)) WHERE n>=2))),
  c AS (SELECT entity, year(date)*12+month(date) AS m, sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date) AS cum FROM {mret}),
  al AS MATERIALIZED (SELECT s.*, h AS horizon, exp(b.cum-a.cum)-1 AS fwd FROM sg s CROSS JOIN (SELECT unnest([1,3])::INTEGER AS h) JOIN c a ON a.entity=s.entity AND a.m=year(s.date)*12+month(s.date) JOIN c b ON b.entity=s.entity AND b.m=a.m+h),
  bk AS (SELECT *, CASE WHEN count(*) OVER f >= 36 THEN 1+len(list_filter(quantile_cont(value,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) OVER f, lambda x: x < value)) END AS bucket, 'pit' AS thresholds FROM al WINDOW f AS (PARTITION BY factor,entity,normalization,horizon ORDER BY date ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT al.*, 1+len(list_filter(q, lambda x: x < value)), 'full' FROM al JOIN (SELECT factor,entity,normalization,horizon, quantile_cont(value,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM al GROUP BY 1,2,3,4) USING (factor,entity,normalization,horizon)),
  ew AS (SELECT date, horizon, avg(fwd) AS ew FROM (SELECT DISTINCT date, entity, horizon, fwd FROM al) GROUP BY 1,2),
  rc AS MATERIALIZED (SELECT factor,entity,normalization,horizon,date,value,bucket,thresholds,'absolute' AS mode, fwd FROM bk WHERE bucket IS NOT NULL UNION ALL SELECT factor,entity,normalization,horizon,date,value,bucket,thresholds,'relative', fwd-ew FROM bk JOIN ew USING (date,horizon) WHERE bucket IS NOT NULL),
  bs AS MATERIALIZED (SELECT factor,entity,normalization,horizon,mode,thresholds,bucket, count(*) AS n, avg(fwd) AS avg_fwd, avg((fwd>0)::INT) AS hit, CASE WHEN count(*)>=3 AND stddev_samp(fwd)>0 THEN avg(fwd)/(stddev_samp(fwd)/sqrt(greatest(2,count(*)/greatest(1,horizon)))) END AS t_stat FROM rc GROUP BY 1,2,3,4,5,6,7)"""


@query("R1_bucket_stats", f"WITH {REC} SELECT * FROM bs", "avg_fwd hit t_stat", digits=5)
def _(t):
    return R.bucket_stats(records(t))


CS = REC + """, rk AS (SELECT *, rank() OVER x + (count(*) OVER (PARTITION BY factor,entity,normalization,horizon,mode,thresholds,value)-1)/2.0 AS rx, rank() OVER y + (count(*) OVER (PARTITION BY factor,entity,normalization,horizon,mode,thresholds,fwd)-1)/2.0 AS ry FROM rc
    WINDOW x AS (PARTITION BY factor,entity,normalization,horizon,mode,thresholds ORDER BY value), y AS (PARTITION BY factor,entity,normalization,horizon,mode,thresholds ORDER BY fwd)),
  ic AS (SELECT factor,entity,normalization,horizon,mode,thresholds, CASE WHEN count(*)>=6 THEN corr(rx,ry) END AS ic, count(*) AS n_records FROM rk GROUP BY 1,2,3,4,5,6 HAVING count(*)>=2),
  ft AS (SELECT factor,entity,normalization,horizon,mode,thresholds, regr_slope(avg_fwd,bucket) AS slope, regr_intercept(avg_fwd,bucket) AS intercept, regr_r2(avg_fwd,bucket) AS r2, max(avg_fwd) FILTER (bucket=10)-max(avg_fwd) FILTER (bucket=1) AS spread FROM bs GROUP BY 1,2,3,4,5,6),
  cb AS (SELECT *, CASE WHEN 1-ic*ic>0 THEN ic*sqrt((greatest(4,n_records/greatest(1,horizon))-2)/(1-ic*ic)) END AS ic_t FROM ic JOIN ft USING (factor,entity,normalization,horizon,mode,thresholds))"""


@query("R2_combo_stats", f"WITH {CS} SELECT factor,entity,normalization,horizon,mode,thresholds, ic, n_records, ic_t, slope, intercept, spread FROM cb", "ic ic_t slope intercept spread", digits=5)
def _(t):
    return R.combo_stats(R.settle(records(t))).drop("r2")


def scanned(t):
    rec = R.settle(records(t))
    cur = R.current_buckets(rec.filter("mode = 'absolute'"), [c for c in R.COMBO if c != "mode"])
    return R.scan(rec, cur)


SCAN = CS + """, cu AS (SELECT factor,entity,normalization,horizon,thresholds, arg_max(bucket,date) AS current_bucket FROM rc WHERE mode='absolute' GROUP BY 1,2,3,4,5),
  s1 AS (SELECT cb.*, current_bucket, b.n AS cur_n, b.avg_fwd AS cur_avg, b.hit AS cur_hit FROM cb JOIN cu USING (factor,entity,normalization,horizon,thresholds) LEFT JOIN bs b ON b.factor=cb.factor AND b.entity=cb.entity AND b.normalization=cb.normalization AND b.horizon=cb.horizon AND b.mode=cb.mode AND b.thresholds=cb.thresholds AND b.bucket=current_bucket),
  s2 AS (SELECT *, CASE WHEN cur_avg IS NULL OR cur_n<5 THEN 'insufficient' WHEN cur_avg>0 THEN 'long' WHEN cur_avg<0 THEN 'short' ELSE 'neutral' END AS direction, CASE WHEN coalesce(sign(slope*current_bucket+intercept)=sign(cur_avg) AND slope*current_bucket+intercept<>0, false) THEN 1 ELSE 0 END AS aligned,
    least(1,coalesce(cur_n,0)/20) AS ss, coalesce(least(1,abs(ic_t)/2.5),0) AS si, coalesce(abs(cur_hit-0.5)*2,0) AS sh FROM s1),
  s3 AS (SELECT *, CASE WHEN count(*) OVER w > 1 AND direction IN ('long','short') THEN (count(*) OVER (PARTITION BY factor,entity,normalization,mode,thresholds,direction)-1)*1.0/(count(*) OVER w - 1) ELSE 0 END AS horizon_agreement FROM s2 WINDOW w AS (PARTITION BY factor,entity,normalization,mode,thresholds)),
  sc AS (SELECT *, CASE WHEN thresholds='pit' THEN round((ss+si+sh+horizon_agreement)/4*aligned,4) ELSE 0 END AS confidence FROM s3)"""


@query("R3_scan_confidence", f"WITH {SCAN} SELECT factor,entity,normalization,horizon,mode,thresholds,current_bucket,direction,aligned,horizon_agreement,confidence FROM sc", "horizon_agreement confidence", digits=3)
def _(t):
    return scanned(t).select(*R.COMBO, "current_bucket", "direction", "aligned", "horizon_agreement", "confidence")


@query("R25_opportunity_queue", f"""WITH {SCAN}, q AS (SELECT factor,entity,normalization,horizon,mode,direction,confidence, confidence*least(abs(ic_t),6)/6*least(r2,1) AS priority FROM sc WHERE thresholds='pit' AND n_records>=20 AND cur_n>=3 AND abs(ic_t)>=0.5 AND coalesce(r2,0)>=0.05 AND direction IN ('long','short') AND (current_bucket<=3 OR current_bucket>=8) AND confidence>=0.1)
   SELECT * FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY entity,factor ORDER BY priority DESC, normalization, mode, horizon)=1) ORDER BY priority DESC, entity, factor LIMIT 15""", "confidence priority", digits=4)
def _(t):
    q = R.opportunity_queue(scanned(t), 20, 0.5, 0.05, 0.1, 15, 3, 3, 8)
    return q.select("factor", "entity", "normalization", "horizon", "mode", "direction", "confidence", "priority")


@query("R4_prior_history", f"""WITH {REC}, rp AS MATERIALIZED (SELECT *, year(date)*12+month(date) AS m FROM rc)
   SELECT a.factor,a.entity,a.normalization,a.horizon,a.mode,a.thresholds,a.date,a.bucket,count(*) AS n, avg(b.fwd) AS avg_fwd, avg((b.fwd>0)::INT) AS hit FROM rp a JOIN rp b ON a.factor=b.factor AND a.entity=b.entity AND a.normalization=b.normalization AND a.mode=b.mode AND a.thresholds=b.thresholds AND a.horizon=b.horizon AND a.bucket=b.bucket AND b.m+b.horizon <= a.m+1 GROUP BY 1,2,3,4,5,6,7,8""", "avg_fwd hit")
def _(t):
    return R.prior_history(records(t))


def drops(t):
    return B.dret(t).filter("ret < -0.097").select(F.concat_ws("-", "entity", F.col("date").cast("string")).alias("event"), "date", "entity", F.lit(1.0).alias("sign"))


EV = """ab AS (SELECT date, entity, ret - avg(ret) OVER (PARTITION BY date) AS ar FROM {dret}), cal AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS p FROM (SELECT DISTINCT date FROM dret)),
   ev AS (SELECT entity||'-'||date::VARCHAR AS event, entity, p AS a FROM dret JOIN cal USING (date) WHERE ret < -0.097 AND p >= 10 AND p+21 < (SELECT count(*) FROM cal)),
   g AS (SELECT event, ev.entity, o::INTEGER AS o, ar FROM ev CROSS JOIN (SELECT unnest(range(-10,22)) AS o) LEFT JOIN (SELECT ab.entity, p, ar FROM ab JOIN cal USING (date)) x ON x.entity=ev.entity AND x.p=ev.a+o),
   k AS (SELECT *, sum(coalesce(ar,0)) OVER (PARTITION BY event ORDER BY o) AS c, avg((ar IS NULL)::INT) OVER (PARTITION BY event) AS miss FROM g),
   pt AS MATERIALIZED (SELECT event, entity, o AS "offset", c - max(CASE WHEN o=0 THEN c END) OVER (PARTITION BY event) AS car FROM k WHERE miss <= 0.4)"""


@query("R5_event_paths", f"WITH {EV} SELECT * FROM pt", "car")
def _(t):
    return R.event_paths(drops(t), B.dret(t), 10, 21)


@query("R5_path_statistics", f"""WITH {EV}, d AS (SELECT CASE WHEN "offset"=-10 THEN 'runup' ELSE '+'||"offset"::VARCHAR END AS label, CASE WHEN "offset"=-10 THEN -car ELSE car END AS v FROM pt WHERE "offset" IN (-10,5,21))
   SELECT label, avg(v) AS mean_car, avg((v>0)::INT) AS hit_rate, count(*) AS n_events, quantile_cont(v,0.5) AS median_car, avg(v)/(stddev_samp(v)/sqrt(count(*))) AS t_stat FROM d GROUP BY 1""", "mean_car hit_rate median_car t_stat")
def _(t):
    return R.path_statistics(R.event_paths(drops(t), B.dret(t), 10, 21), [5, 21]).drop("p_value")


@query("R5_bootstrap_band")
def _(t):
    return R.bootstrap_band(R.event_paths(drops(t), B.dret(t), 10, 21), 100)


def macro(t):
    """Monthly totals rescaled into the ranges of the macro indicators."""
    m = B.monthly(t).groupBy("date").agg(*[F.sum(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in "ANR"])
    pct = lambda c, lo, hi: F.lit(lo) + (F.floor(F.col(c) / 1000) % 100) / 100 * (hi - lo)
    d = m.select("date", pct("A", 10.0, 32.0).alias("vix"), pct("N", 1.3, 3.8).alias("baa_oas"), pct("R", -0.5, 2.0).alias("yield_2s10s"), pct("A", -1.0, 1.0).alias("fed_funds_chg_12m"), pct("N", 0.0, 6.0).alias("cpi_yoy"), pct("R", 55.0, 105.0).alias("umcsent"),
                 (F.floor(F.col("N") / 1000) % 9 == 0).cast("int").alias("nber_recession"), (F.floor(F.col("R") / 1000) % 11 == 0).cast("int").alias("sahm_triggered"))
    w = Window.orderBy("date")
    return d.withColumns({"baa_oas_chg_3m": F.col("baa_oas") - F.lag("baa_oas", 3).over(w), "umcsent_chg_3m": F.col("umcsent") - F.lag("umcsent", 3).over(w)})


def _pct(c, lo, hi):
    return f"({lo} + (floor({c}/1000)::BIGINT % 100)/100.0*({hi - lo}))"


RG = f"""mm AS (SELECT date, sum(value) FILTER (variable='A') AS "A", sum(value) FILTER (variable='N') AS "N", sum(value) FILTER (variable='R') AS "R" FROM {{monthly}} GROUP BY 1),
   mc AS (SELECT date, {_pct('"A"',10.0,32.0)} AS vix, {_pct('"N"',1.3,3.8)} AS oas, {_pct('"R"',-0.5,2.0)} AS curve, {_pct('"A"',-1.0,1.0)} AS fed, {_pct('"N"',0.0,6.0)} AS cpi, {_pct('"R"',55.0,105.0)} AS s, floor("N"/1000)::BIGINT%9=0 AS nber, floor("R"/1000)::BIGINT%11=0 AS sahm FROM mm),
   ml AS (SELECT *, lag(vix,3) OVER w AS v3, oas-lag(oas,3) OVER w AS d3, s-lag(s,3) OVER w AS s3 FROM mc WINDOW w AS (ORDER BY date)),
   rg AS (SELECT date, CASE WHEN vix>30 OR oas>3.5 OR (vix>25 AND oas>2.5) THEN 'R1_Crisis' WHEN nber OR sahm THEN 'R3_Recession' WHEN fed>0 AND curve<0.5 AND vix<25 AND oas<2.5 THEN 'R2_Late-cycle' WHEN coalesce((v3>25 AND vix<22)::INT,0)+coalesce((d3<0)::INT,0)+coalesce((s3>0)::INT,0)>=2 THEN 'R4_Recovery'
      WHEN vix<20 AND curve>0.5 AND s>90 AND NOT nber THEN 'R5_Expansion' WHEN cpi>4 AND s<70 THEN 'R6_Stagflation' ELSE 'R7_Transition' END AS rule FROM ml),
   rt AS MATERIALIZED (SELECT date, rule, CASE rule WHEN 'R1_Crisis' THEN 'Crisis' WHEN 'R3_Recession' THEN 'Recession' WHEN 'R2_Late-cycle' THEN 'Late-cycle' WHEN 'R4_Recovery' THEN 'Expansion' WHEN 'R5_Expansion' THEN 'Expansion' WHEN 'R6_Stagflation' THEN 'Late-cycle' ELSE 'Transition' END AS regime FROM rg)"""


@query("R6_regime_tags", f"WITH {RG} SELECT * FROM rt")
def _(t):
    return R.tag_regimes(macro(t)).select("date", "rule", "regime")


def factor_ic(t):
    ic = H.rank_ic(H.align_monthly(signals(t), B.mret(t), [1, 3, 6]))
    return ic.select(F.concat_ws("|", "signal", F.col("horizon").cast("string")).alias("factor"), "date", "ic")


@query("R7_conditional_ic", f"""WITH {IC}, {RG}, m AS (SELECT signal||'|'||horizon::VARCHAR AS factor, date, ic, regime FROM ic JOIN rt USING (date)), g AS (SELECT factor, regime, count(*) AS n, avg(ic) AS m, var_pop(ic) AS v FROM m GROUP BY 1,2),
   a AS (SELECT factor, (sum(n*m*m)-sum(n*m)**2/sum(n))/(count(*)-1) / (sum(n*v)/(sum(n)-count(*))) AS f_stat FROM g WHERE n>=5 GROUP BY 1) SELECT a.factor, f_stat, stddev_samp(g.m) AS ic_dispersion, max(g.m)>0 AND min(g.m)<0 AS sign_reversal, any_value(u) AS ic_unconditional FROM a JOIN g ON g.factor=a.factor JOIN (SELECT factor, avg(ic) AS u FROM m GROUP BY 1) u ON u.factor=a.factor GROUP BY 1,2""", "f_stat ic_dispersion ic_unconditional")
def _(t):
    return R.conditional_ic(factor_ic(t), R.tag_regimes(macro(t))).drop("p_value", "p_adj", "significant")


@query("R7_bh_adjust", """WITH p AS (SELECT p_partkey::VARCHAR AS factor, (p_partkey*7919 % 10007)/10007.0 AS p_value FROM part), r AS (SELECT *, p_value*count(*) OVER ()/row_number() OVER (ORDER BY p_value, factor) AS q, row_number() OVER (ORDER BY p_value, factor) AS i FROM p)
   SELECT factor, p_value, least(1, min(q) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj, least(1, min(q) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) <= 0.2 AS significant FROM r""", "p_value p_adj")
def _(t):
    return R.bh_adjust(t.part.select(F.col("p_partkey").cast("string").alias("factor"), ((F.col("p_partkey") * 7919 % 10007) / 10007).alias("p_value")))


CLS = """cl AS (SELECT entity, date, pct, CASE WHEN pct<=0.3 THEN 'Recession' WHEN pct>=0.7 THEN 'Growth' ELSE 'Neutral' END AS regime FROM (SELECT entity, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, (len(list_filter(h, lambda v: v<=value))+len(list_filter(h, lambda v: v<value)))/2.0/len(h) AS pct, (year(date)-year(f))*12+month(date)-month(f) AS sp, len(h) AS n FROM
   (SELECT *, array_agg(value) OVER w AS h, min(date) OVER w AS f FROM {sales} WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING))) WHERE sp>=24 AND n>=3)"""


@query("R8_expanding_regime", f"WITH {CLS} SELECT * FROM cl", "pct")
def _(t):
    return R.expanding_regime(B.sales(t), 24, lag_months=1)


def ranked(t):
    p = factor_panel(t).withColumnRenamed("value", "signal").join(B.mret(t), ["date", "entity"])
    return R.standardised_ranks(p)


@query("R9_standardised_ranks", """WITH j AS (SELECT variable AS factor, m.date, m.entity, value, ret FROM {monthly} m JOIN {mret} r ON r.date=m.date AND r.entity=m.entity), r AS (SELECT *, rank() OVER a + (count(*) OVER (PARTITION BY factor,date,value)-1)/2.0 AS rs, rank() OVER b + (count(*) OVER (PARTITION BY factor,date,ret)-1)/2.0 AS rr, count(*) OVER (PARTITION BY factor,date) AS n FROM j
   WINDOW a AS (PARTITION BY factor,date ORDER BY value), b AS (PARTITION BY factor,date ORDER BY ret)) SELECT factor, date, entity, (rs-avg(rs) OVER g)/stddev_samp(rs) OVER g AS rank_signal, (rr-avg(rr) OVER g)/stddev_samp(rr) OVER g AS rank_ret FROM r WHERE n>=10 WINDOW g AS (PARTITION BY factor,date)""", "rank_signal rank_ret")
def _(t):
    return ranked(t)


@query("R9_interaction_test")
def _(t):
    return R.interaction_test(ranked(t), R.expanding_regime(B.sales(t), 12))


@query("R9_placebo_test")
def _(t):
    return R.interaction_test(ranked(t), R.expanding_regime(B.sales(t), 12), placebo=7)


def state_features(t):
    z = N.cross_z(B.sales(t)).select("entity", "date", F.col("z").alias("f1"))
    m = B.mret(t).select("entity", "date", (F.col("ret") * 50).alias("f2"))
    return z.join(m, ["entity", "date"]).filter("f1 IS NOT NULL")


def forward(t):
    return B.mret(t).withColumn("ret", F.lead("ret").over(Window.partitionBy("entity").orderBy("date"))).filter("ret IS NOT NULL")


@query("R10_hidden_states")
def _(t):
    return R.hidden_states(state_features(t), forward(t), ["f1", "f2"], 36)


@query("R11_warning_gates")
def _(t):
    s = R.hidden_states(state_features(t), forward(t), ["f1", "f2"], 36)
    return R.warning_gates(s, B.mret(t), 50)


def fragility(t):
    m = B.monthly(t)
    parts = {v: R.fragility_component(m.filter(F.col("variable") == v), s) for v, s in (("A", 1), ("N", -1), ("R", 1))}
    return R.fragility_composite(parts, 2)


FRAG = """q AS (SELECT date, variable, quantile_cont(value,0.01) AS lo, quantile_cont(value,0.99) AS hi FROM {monthly} GROUP BY 1,2), wv AS (SELECT m.date, entity, m.variable, greatest(least(value,hi),lo) AS v FROM monthly m JOIN q USING (date, variable)),
   cz AS (SELECT date, entity, variable, CASE WHEN stddev_pop(v) OVER g>0 THEN (v-avg(v) OVER g)/stddev_pop(v) OVER g END AS cs FROM wv WINDOW g AS (PARTITION BY date, variable)),
   tz AS (SELECT date, entity, variable, CASE WHEN count(cs) OVER f>=24 AND stddev_pop(cs) OVER f>0 THEN (cs-avg(cs) OVER f)/stddev_pop(cs) OVER f END * CASE WHEN variable='N' THEN -1 ELSE 1 END AS c FROM cz WINDOW f AS (PARTITION BY entity, variable ORDER BY date ROWS UNBOUNDED PRECEDING)),
   fr AS MATERIALIZED (SELECT date, entity, avg(c) AS composite, count(c) AS n_components FROM tz WHERE c IS NOT NULL GROUP BY 1,2 HAVING count(c)>=2)"""


@query("R12_fragility_composite", f"WITH {FRAG} SELECT * FROM fr", "composite")
def _(t):
    return fragility(t)


WFQ = FRAG + """, yy AS (SELECT DISTINCT year(date) AS y FROM fr), ct AS (SELECT y, quantile_cont(composite,0.25) AS q1, quantile_cont(composite,0.75) AS q3 FROM yy JOIN fr ON year(date)<y GROUP BY 1 HAVING count(*)>=60),
   lb AS (SELECT fr.*, CASE WHEN composite<=q1 THEN 'bottom' WHEN composite>=q3 THEN 'top' END AS side FROM fr JOIN ct ON y=year(date))"""


@query("R13_walk_forward_quartiles", f"WITH {WFQ} SELECT * FROM lb", "composite")
def _(t):
    return R.walk_forward_quartiles(fragility(t))


@query("R13_pooled_test", f"""WITH {WFQ}, fw AS (SELECT entity, date, lead(ret) OVER (PARTITION BY entity ORDER BY date) AS fwd FROM {{mret}}) SELECT year(lb.date) AS year, avg(fwd) FILTER (side='bottom') AS bottom, avg(fwd) FILTER (side='top') AS top, corr(composite,fwd) AS corr, count(*) AS n, avg(fwd) FILTER (side='top')-avg(fwd) FILTER (side='bottom') AS spread FROM lb JOIN fw ON fw.entity=lb.entity AND fw.date=lb.date WHERE fwd IS NOT NULL GROUP BY 1""", "bottom top corr spread")
def _(t):
    lab = R.walk_forward_quartiles(fragility(t)).join(forward(t).withColumnRenamed("ret", "fwd"), ["entity", "date"])
    return R.pooled_test(lab)


@query("R26_volatility_gate", f"""WITH {FRAG}, v AS (SELECT entity, date, CASE WHEN count(ret) OVER f=6 THEN stddev_samp(ret) OVER f END AS v FROM {{mret}} WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) SELECT fr.entity, count(*) AS n, CASE WHEN count(*)>=24 THEN corr(composite,v) END AS corr_vol FROM fr JOIN v ON v.entity=fr.entity AND v.date=fr.date WHERE v IS NOT NULL GROUP BY 1""", "corr_vol")
def _(t):
    return R.volatility_gate(fragility(t), B.mret(t))


def annual(t):
    """Each customer segment and nation as a country; quarters as years of a long history."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy((F.col("c_nationkey")).cast("string").alias("entity"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("int").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))
    x = F.floor(F.col("v")).cast("long")
    u = lambda k, lo, hi: F.lit(lo) + (x % k) / float(k) * (hi - lo)
    return g.select("entity", "year", u(97, -0.4, 0.5).alias("eq_tr"), u(89, -0.1, 0.15).alias("bond_tr"), u(83, 0.0, 0.06).alias("bill_rate"), (F.lit(100.0) + (x % 13)).alias("cpi"), (x % 17 == 0).cast("int").alias("crisis"))


def _u(k, lo, hi):
    return f"({lo} + (x % {k})/{float(k)}*({hi - lo}))"


_ASSETS = [(a, h) for a in ("equity", "bond", "bill") for h in (1, 3)]
TAILS = f"""an AS (SELECT c_nationkey::VARCHAR AS entity, (year(o_orderdate)*4+quarter(o_orderdate)) AS year, floor(round(sum(o_totalprice),2))::BIGINT AS x FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2),
   a1 AS (SELECT entity, year, {_u(97,-0.4,0.5)} AS eq, {_u(89,-0.1,0.15)} AS bd, {_u(83,0.0,0.06)} AS bl, 100.0+(x%13) AS cpi, x%17=0 AS crisis FROM an), a2 AS (SELECT *, cpi/lag(cpi) OVER (PARTITION BY entity ORDER BY year)-1 AS infl FROM a1),
   a3 AS (SELECT *, (1+eq)/(1+infl)-1 AS equity, (1+bd)/(1+infl)-1 AS bond, (1+bl)/(1+infl)-1 AS bill FROM a2), a4 AS (SELECT *, exp(sum(ln(1+coalesce(equity,0))) OVER (PARTITION BY entity ORDER BY year)) AS ix FROM a3), a5 AS (SELECT *, ix/max(ix) OVER (PARTITION BY entity ORDER BY year)-1 AS dd FROM a4),
   a6 AS (SELECT *, coalesce(max(crisis::INT) OVER (PARTITION BY entity ORDER BY year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)=1,false) AS post, {", ".join(f"CASE WHEN count({a}) OVER w{h}={h} THEN exp(sum(ln(1+{a})) OVER w{h}/{h})-1 END AS {a}_{h}" for a, h in _ASSETS)}, coalesce(max((abs(infl)>0.5)::INT) OVER w1=1,false) AS hy1, coalesce(max((abs(infl)>0.5)::INT) OVER w3=1,false) AS hy3 FROM a5 WINDOW w1 AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), w3 AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
   st AS ({" UNION ALL ".join(f"SELECT *, '{n}' AS state, coalesce({c},false) AS on_ FROM a6" for n, c in (("normal", "dd>-0.10 AND NOT crisis"), ("banking_crisis", "crisis"), ("post_crisis_1_3y", "post"), ("dd_0_10", "dd>-0.10 AND dd<=0"), ("dd_10_20", "dd>-0.20 AND dd<=-0.10"), ("dd_20_35", "dd>-0.35 AND dd<=-0.20"), ("dd_35_plus", "dd>-1.01 AND dd<=-0.35")))}),
   ep AS (SELECT state, sum((on_ AND NOT pv)::INT)::BIGINT AS n_episodes FROM (SELECT state, on_, coalesce(lag(on_) OVER (PARTITION BY entity, state ORDER BY year),false) AS pv FROM st) GROUP BY 1),
   ce AS ({" UNION ALL ".join(f"SELECT state, '{a}' AS asset, {h} AS horizon, {a}_{h} AS x, hy{h} AS hy FROM st WHERE on_" for a, h in _ASSETS)}), cv AS (SELECT *, 'all' AS variant FROM ce WHERE x IS NOT NULL UNION ALL SELECT *, 'ex_hyperinflation' FROM ce WHERE x IS NOT NULL AND NOT hy),
   tl AS (SELECT cv.state, asset, horizon, variant, count(*) AS n_obs, avg(x) AS mean, stddev_samp(x) AS std, avg((x<0)::INT) AS prob_neg, quantile_cont(x,0.1) AS p10, quantile_cont(x,0.25) AS p25, quantile_cont(x,0.5) AS p50, quantile_cont(x,0.75) AS p75, quantile_cont(x,0.9) AS p90, any_value(n_episodes) AS n_episodes FROM cv JOIN ep USING (state) GROUP BY 1,2,3,4)"""


@query("R14_R27_history_tails", f"WITH {TAILS} SELECT * FROM tl", "mean std prob_neg p10 p25 p50 p75 p90")
def _(t):
    return R.history_tails(annual(t), [1, 3])


@query("R15_current_tails", f"""WITH {TAILS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY entity) AS n FROM {{dret}}), l AS (SELECT entity, date, exp(sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date)) AS lv FROM r WHERE r<=1260 AND n>=60), d AS (SELECT entity, arg_max(lv,date)/max(lv)-1 AS drawdown FROM l GROUP BY 1),
   b AS (SELECT *, CASE WHEN drawdown<=-0.35 THEN 'dd_35_plus' WHEN drawdown<=-0.20 THEN 'dd_20_35' WHEN drawdown<=-0.10 THEN 'dd_10_20' ELSE 'dd_0_10' END AS state FROM d) SELECT b.*, n_obs, p10, p50, p90, prob_neg FROM b LEFT JOIN tl ON tl.state=b.state AND asset='equity' AND horizon=3 AND variant='all'""", "drawdown p10 p50 p90 prob_neg")
def _(t):
    return R.current_tails(B.dret(t), R.history_tails(annual(t), [1, 3]))


def night_prints(t):
    e = t.events
    return e.select((F.col("user_id") % 40).alias("market_id"), (F.col("user_id") % 8).alias("ticker"), "ts", ((F.floor(F.col("value") * 100) % 101) / 100).alias("p"))


def bars(t):
    e = t.events.groupBy((F.col("user_id") % 8).alias("ticker"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 2).alias("v"), F.count("*").alias("n"))
    return e.filter("dayofweek(date) NOT IN (1,7)").select("ticker", "date", (F.col("v") + 100).alias("px_open"), (F.col("v") + 90 + F.col("n")).alias("px_last"))


NIGHT = """pr AS (SELECT user_id%40 AS market_id, user_id%8 AS ticker, ts, (floor(value*100)::BIGINT%101)/100.0 AS p FROM events), pf AS (SELECT * FROM pr WHERE p>0.02 AND p<0.98), br AS (SELECT user_id%8 AS ticker, CAST(ts AS DATE) AS date, round(sum(value),2)+100 AS px_open, round(sum(value),2)+90+count(*) AS px_last FROM events WHERE dayofweek(ts) NOT IN (0,6) GROUP BY 1,2),
   cl AS (SELECT market_id, ticker, CAST(ts AS DATE) AS d, arg_max(p,ts) AS p_close FROM pf WHERE strftime(ts,'%H:%M:%S')>='12:00:00' AND strftime(ts,'%H:%M:%S')<'20:00:00' GROUP BY 1,2,3), op AS (SELECT market_id, CAST(ts AS DATE) AS d_next, arg_min(p,ts) AS p_open FROM pf WHERE strftime(ts,'%H:%M:%S')>='01:00:00' AND strftime(ts,'%H:%M:%S')<'12:00:00' GROUP BY 1,2),
   ca AS (SELECT d, lead(d) OVER (ORDER BY d) AS d_next FROM (SELECT DISTINCT date AS d FROM br)), bl AS (SELECT *, lag(px_last) OVER w AS pc, lag(date) OVER w AS pd FROM br WINDOW w AS (PARTITION BY ticker ORDER BY date)),
   np AS MATERIALIZED (SELECT cl.market_id, cl.ticker, cl.d, ca.d_next, p_close, p_open, p_open-p_close AS delta_p, ln(px_open/pc) AS r_gap, ln(px_last/px_open) AS r_cont FROM cl JOIN ca ON ca.d=cl.d JOIN op ON op.market_id=cl.market_id AND op.d_next=ca.d_next JOIN bl ON bl.ticker=cl.ticker AND bl.date=ca.d_next AND pd=cl.d)"""


def nights(t):
    return R.overnight_pairs(night_prints(t), bars(t), "12:00:00", "20:00:00", "01:00:00", "12:00:00")


@query("R16_overnight_pairs", f"WITH {NIGHT} SELECT * FROM np", "p_close p_open delta_p r_gap r_cont")
def _(t):
    return nights(t)


@query("R17_clustered_slope", f"""WITH {NIGHT}, d AS (SELECT market_id, r_gap-avg(r_gap) OVER g AS y, delta_p-avg(delta_p) OVER g AS x FROM np WINDOW g AS (PARTITION BY market_id)), s AS (SELECT sum(x*y)/sum(x*x) AS gamma, sum(x*x) AS xx, sum(x*y)**2/(sum(x*x)*sum(y*y)) AS r2, count(*) AS n FROM d), u AS (SELECT market_id, sum(x*y)-gamma*sum(x*x) AS u FROM d, s GROUP BY market_id, gamma)
   SELECT gamma, gamma/(sqrt((SELECT sum(u*u) FROM u)*k/(k-1))/xx) AS t_stat, r2, n, k AS n_clusters FROM s, (SELECT count(*) AS k FROM u)""", "gamma t_stat r2")
def _(t):
    return R.clustered_slope(nights(t), "r_gap", "delta_p", "market_id", "market_id")


@query("R17_next_night_placebo", f"""WITH {NIGHT}, q AS (SELECT *, lead(r_gap) OVER (PARTITION BY market_id ORDER BY d) AS ng FROM np), d AS (SELECT market_id, ng-avg(ng) OVER g AS y, delta_p-avg(delta_p) OVER g AS x FROM q WHERE ng IS NOT NULL WINDOW g AS (PARTITION BY market_id)) SELECT sum(x*y)/sum(x*x) AS gamma, count(*) AS n FROM d""", "gamma")
def _(t):
    return R.clustered_slope(R.next_night(nights(t)), "next_gap", "delta_p", "market_id", "market_id").select("gamma", "n")


@query("R18_threshold_pnl", f"""WITH {NIGHT}, a AS (SELECT ticker, d_next, sum(delta_p*w)/sum(w) AS dp, any_value(r_gap) AS gap, any_value(r_cont) AS con FROM (SELECT *, greatest(1,market_id*10.0) AS w FROM np) GROUP BY 1,2), s AS (SELECT a.*, theta FROM a, (SELECT unnest([0.05,0.15])::DOUBLE AS theta) WHERE abs(dp)>=theta), l AS (SELECT theta, 'gap' AS leg, d_next, sign(dp)*gap AS pnl FROM s UNION ALL SELECT theta, 'continuation', d_next, sign(dp)*con FROM s),
   d AS (SELECT theta, leg, d_next, avg(pnl) AS pnl, count(*) AS n FROM l GROUP BY 1,2,3), e AS (SELECT d.*, c AS cost_bps, pnl-2*c/1e4 AS net FROM d, (SELECT unnest([0,5])::DOUBLE AS c)) SELECT theta, leg, cost_bps, count(*) AS n_days, sum(n)::BIGINT AS n_trades, avg(net)*252 AS ann_return, avg(net)/stddev_samp(net)*sqrt(252) AS sharpe, avg((net>0)::INT) AS hit_rate FROM e GROUP BY 1,2,3""", "ann_return sharpe hit_rate")
def _(t):
    return R.threshold_pnl(nights(t).withColumn("volume", F.col("market_id") * 10.0), [0.05, 0.15], [0, 5])


def diffs(t):
    return t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id").select("source", ((F.col("quality") - 0.5) ** 2 - (F.col("n_chars") % 100) / 400).alias("diff"))


@query("R19_leave_one_cluster_out", """WITH d AS (SELECT source, (quality-0.5)**2-(n_chars%100)/400.0 AS diff FROM labels JOIN documents USING (doc_id)) SELECT source, (SELECT avg(diff) FROM d) AS "full", (SELECT avg(b.diff) FROM d b WHERE b.source<>a.source) AS without FROM (SELECT DISTINCT source FROM d) a""", "full without")
def _(t):
    return R.leave_one_cluster_out(diffs(t), "diff", "source")


@query("R19_clustered_bootstrap")
def _(t):
    return R.clustered_mean_difference(diffs(t), "diff", "source", 200)


@query("R20_spectral_diagnostics")
def _(t):
    w = N.cross_z(B.monthly(t)).groupBy("date", "entity").agg(*[F.max(F.when(F.col("variable") == v, F.col("z"))).alias(v) for v in "ANR"]).join(forward(t), ["date", "entity"])
    return R.spectral_diagnostics(w, ["A", "N", "R"], "ret")


@query("R21_dominance", """WITH c AS (SELECT entity, sum(ret) AS contribution FROM {mret} GROUP BY 1) SELECT *, abs(contribution)/(SELECT sum(abs(contribution)) FROM c) AS share, abs(contribution)/(SELECT sum(abs(contribution)) FROM c)>0.5 AS dominates FROM c""", "contribution share")
def _(t):
    return R.dominance(B.mret(t), "entity", "ret")


@query("R21_leave_one_window_out", f"""WITH {IC}, x AS (SELECT date, ic FROM ic WHERE signal='A' AND horizon=1), w AS (SELECT * FROM (VALUES ('w1',DATE '1997-01-01',DATE '1998-12-31'),('w2',DATE '2000-01-01',DATE '2000-06-30')) v(n,a,b)) SELECT n AS "window", avg(ic) AS full_ic, avg(ic) FILTER (NOT date BETWEEN a AND b) AS without, avg(ic) FILTER (NOT date BETWEEN a AND b)/avg(ic) AS residual, CASE WHEN avg(ic) FILTER (NOT date BETWEEN a AND b)/avg(ic) < 0.5 THEN 'warning' ELSE 'pass' END AS status FROM x, w GROUP BY 1""", "full_ic without residual", digits=5)
def _(t):
    ic = factor_ic(t).filter("factor = 'A|1'")
    return R.leave_one_window_out(ic, [("w1", "1997-01-01", "1998-12-31"), ("w2", "2000-01-01", "2000-06-30")])


@query("R21_leave_one_window_out_all", f"""WITH {IC}, w AS (SELECT * FROM (VALUES ('w1',DATE '1997-01-01',DATE '1998-12-31'),('w2',DATE '2000-01-01',DATE '2000-06-30')) v(n,a,b)) SELECT signal||'|'||horizon::VARCHAR AS factor, n AS "window", avg(ic) AS full_ic, avg(ic) FILTER (NOT date BETWEEN a AND b) AS without, avg(ic) FILTER (NOT date BETWEEN a AND b)/avg(ic) AS residual, CASE WHEN avg(ic) FILTER (NOT date BETWEEN a AND b)/avg(ic) < 0.5 THEN 'warning' ELSE 'pass' END AS status FROM ic, w GROUP BY signal, horizon, n""", "full_ic without residual", digits=5)
def _(t):
    return R.leave_one_window_out(factor_ic(t), [("w1", "1997-01-01", "1998-12-31"), ("w2", "2000-01-01", "2000-06-30")], by=["factor"])


@query("R21_detectable_band", """WITH a AS (SELECT count(DISTINCT date) AS o, count(DISTINCT entity) AS k FROM {mret}), b AS (SELECT *, floor(o/3) AS bl FROM a) SELECT o AS n_obs, k AS n_entities, round(greatest(1,bl*k/(1+(k-1)*0.55))) AS effective_n_lo, round(greatest(1,bl*k/(1+(k-1)*0.25))) AS effective_n_hi, round(2.8/sqrt(greatest(1,bl*k/(1+(k-1)*0.25))),3) AS detectable_ic_lo, round(2.8/sqrt(greatest(1,bl*k/(1+(k-1)*0.55))),3) AS detectable_ic_hi FROM b""", "effective_n_lo effective_n_hi detectable_ic_lo detectable_ic_hi")
def _(t):
    return R.detectable_band(B.mret(t), 3)


@query("R22_analog_outcomes", """WITH f AS (SELECT entity, date, h AS horizon, CASE WHEN h=1 THEN CASE WHEN count(ret) OVER w1=1 THEN exp(sum(ln(1+ret)) OVER w1)-1 END ELSE CASE WHEN count(ret) OVER w3=3 THEN exp(sum(ln(1+ret)) OVER w3)-1 END END AS fwd FROM {mret}, (SELECT unnest([1,3])::INTEGER AS h) WINDOW w1 AS (PARTITION BY entity, h ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), w3 AS (PARTITION BY entity, h ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
   b AS (SELECT entity, horizon, avg(fwd) AS base FROM f GROUP BY 1,2) SELECT f.entity, f.date, f.horizon, fwd, base, fwd-base AS excess FROM f JOIN b USING (entity, horizon) WHERE month(date)=3""", "fwd base excess")
def _(t):
    return R.attach_analog_outcomes(B.mret(t).filter("month(date) = 3").select("entity", "date"), B.mret(t), [1, 3])


@query("R23_trim_thin_months", """SELECT * FROM {mret} WHERE date <= (SELECT max(date) FROM (SELECT date FROM mret GROUP BY 1 HAVING count(DISTINCT entity)>=25))""", "ret")
def _(t):
    return R.trim_thin_months(B.mret(t), 25)


@query("R24_episode_validation", """WITH z AS (SELECT date, entity, CASE WHEN count(value) OVER f>=24 AND stddev_samp(value) OVER f>0 THEN (value-avg(value) OVER f)/stddev_samp(value) OVER f END AS z FROM {sales} WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 35 PRECEDING)), e AS (SELECT * FROM (VALUES ('shock_a','NATION_3',DATE '1998-01-01',DATE '1999-06-01'),('shock_b','NATION_9',DATE '2000-01-01',DATE '2000-12-01')) v(n,c,a,b))
   SELECT n AS episode, entity, max(abs(z)) AS peak_abs_z, arg_max(z,abs(z)) AS z_at_peak, arg_max(date,abs(z)) AS peak_date FROM z JOIN e ON entity=c AND date BETWEEN a AND b GROUP BY 1,2""", "peak_abs_z z_at_peak")
def _(t):
    return R.episode_backtest(B.sales(t), [("shock_a", "NATION_3", "1998-01-01", "1999-06-01"), ("shock_b", "NATION_9", "2000-01-01", "2000-12-01")])
