"""Detector and episode queries (monthly panels stand in for daily ones, so windows are short)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import episodes as E
from ..operators import features as X
from ..operators import graph as G
from ..operators.normalise import cross_z
from . import base as B
from .base import query
from .graph_queries import EDGES, NORM, edges, metric
from .feature_queries import VINT, vintages


def lz(name, src, w=60, n=24):
    return (f"{name} AS (SELECT entity, (max(value) FILTER (r=1)-avg(value))/nullif(stddev_samp(value),0) AS z, max(value) FILTER (r=1) AS v, max(date) AS d FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r, "
            f"count(*) OVER (PARTITION BY entity) AS n FROM ({src}) WHERE value IS NOT NULL) WHERE r<={w} AND n>={n} GROUP BY 1)")


def tr(n, src="{mret}"):
    return f"SELECT entity, date, CASE WHEN count(*) OVER f >= {n} THEN exp(sum(ln(1+ret)) OVER f)-1 END AS value FROM {src} WINDOW f AS (PARTITION BY entity ORDER BY date ROWS {n-1} PRECEDING)"


def own(t, n=3):
    return X.trailing_return(B.mret(t), n).select("entity", "date", F.col("trailing").alias("value"))


def level(t, v):
    return B.monthly(t).filter(F.col("variable") == v).select("entity", "date", "value")


def show(df, *keys):
    return df.select("detector", "archetype", "entity", "direction", "severity", *[F.col("components")[k].alias(k) for k in keys])


def chg(n, v, kind="diff", sign=1):
    e = f"value-lag(value,{n}) OVER (PARTITION BY entity ORDER BY date)" if kind == "diff" else f"value/lag(value,{n}) OVER (PARTITION BY entity ORDER BY date)-1"
    src = f"(SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY date) AS p FROM {{monthly}} WHERE variable='{v}') WHERE p IS NULL OR p<>value)"
    return f"SELECT entity, date, {sign}*({e}) AS value FROM {src}"


@query("D1_terms_of_trade", f"""WITH sh AS (SELECT n_name AS entity, variable AS category, (CASE variable WHEN 'A' THEN 0.3 WHEN 'N' THEN -0.2 ELSE 0.1 END)*(n_nationkey%5-2) AS net_share FROM nation, (SELECT DISTINCT variable FROM {{monthly}})),
   tot AS (SELECT variable, date, sum(value) AS v FROM monthly GROUP BY 1,2), cm AS (SELECT variable AS category, date, v/lag(v,3) OVER (PARTITION BY variable ORDER BY date)-1 AS ret FROM tot),
   bk AS (SELECT sh.entity, date, sum(net_share*ret) AS value FROM sh JOIN cm USING (category) WHERE ret IS NOT NULL GROUP BY 1,2), {lz('t','SELECT * FROM bk',36,24)}, {lz('o',tr(3))}, {lz('r',chg(3,'R'),36,24)}
   SELECT 'D1' AS detector, 'A1' AS archetype, t.entity, CASE WHEN t.z>0 THEN 'long' ELSE 'short' END AS direction, round(t.z,2) AS severity, t.v AS tot_impulse, t.z AS tot_z, o.z AS own_z, r.z AS reer_z FROM t JOIN o ON o.entity=t.entity LEFT JOIN r ON r.entity=t.entity WHERE abs(t.z)>=0.5 AND abs(o.z)<1.5 AND coalesce(abs(r.z),0)<2""", "severity tot_impulse tot_z own_z reer_z")
def _(t):
    m = B.monthly(t)
    w = F.when(F.col("category") == "A", 0.3).when(F.col("category") == "N", -0.2).otherwise(0.1)
    cats = F.explode(F.array(*[F.lit(c) for c in "ANR"])).alias("category")
    sh = t.nation.select(F.col("n_name").alias("entity"), "n_nationkey", cats).withColumn("net_share", w * (F.col("n_nationkey") % 5 - 2))
    tot = m.groupBy(F.col("variable").alias("category"), "date").agg(F.sum("value").alias("v"))
    cm = tot.withColumn("ret", F.col("v") / F.lag("v", 3).over(Window.partitionBy("category").orderBy("date")) - 1)
    d = D.d1_terms_of_trade(sh, cm, own(t), level(t, "R"), 0.5, 1.5, 2.0, 36, 24, 60, 24)
    return show(d, "tot_impulse", "tot_z", "own_z", "reer_z")


@query("D2_graph_propagation", f"""WITH {NORM}, h AS (SELECT a.src, b.dst, sum(a.weight*b.weight) AS weight FROM w a JOIN w b ON a.dst=b.src WHERE a.src<>b.dst GROUP BY 1,2),
   g1 AS (SELECT src AS entity, m.date, sum(weight*m.ret)/sum(weight) - any_value(x.ret) AS value FROM e JOIN {{mret}} m ON m.entity=e.dst JOIN mret x ON x.entity=e.src AND x.date=m.date GROUP BY 1,2),
   g2 AS (SELECT src AS entity, m.date, sum(weight*m.ret)/sum(weight) - any_value(x.ret) AS value FROM h JOIN mret m ON m.entity=h.dst JOIN mret x ON x.entity=h.src AND x.date=m.date GROUP BY 1,2),
   {lz('a','SELECT * FROM g1')}, {lz('b','SELECT * FROM g2')}, {lz('o',tr(3))}
   SELECT 'D2' AS detector, 'A2' AS archetype, a.entity, CASE WHEN a.z>0 THEN 'long' ELSE 'short' END AS direction, round(a.z,2) AS severity, a.z AS gap_z, NULL AS twohop_z, o.z AS own_z FROM a LEFT JOIN o ON o.entity=a.entity WHERE abs(a.z)>=0.8
   UNION ALL SELECT 'D2','A2', b.entity, CASE WHEN b.z>0 THEN 'long' ELSE 'short' END, round(b.z,2), NULL, b.z, o.z FROM b JOIN o ON o.entity=b.entity JOIN a ON a.entity=b.entity WHERE abs(b.z)>=0.8 AND abs(o.z)<0.9""", "severity gap_z twohop_z own_z")
def _(t):
    m, e = metric(t), edges(t)
    one = G.neighbour_gap(m, e, "G1")
    two = G.two_hop_mean(m, e).join(m.withColumnRenamed("value", "_o"), ["entity", "date"]).select("entity", "date", (F.col("nbr") - F.col("_o")).alias("value"))
    return show(D.d2_graph_propagation(one, two, own(t), 0.8, 0.9, 60, 24), "gap_z", "twohop_z", "own_z")


REVS = f"(SELECT vintage, entity, value - lag(value) OVER (PARTITION BY entity, variable, target_year ORDER BY vintage) AS revision FROM {VINT} WHERE variable='F')"


@query("D3_revision_momentum", f"""WITH rv AS (SELECT * FROM {REVS} WHERE vintage <= DATE '2001-05-01'), av AS (SELECT vintage, entity, avg(revision) AS r FROM rv WHERE revision IS NOT NULL GROUP BY 1,2), mx AS (SELECT max(vintage) AS v FROM rv),
   s AS (SELECT entity, max(r) FILTER (vintage=v) AS cur, avg(r) FILTER (vintage<>v) AS m, stddev_samp(r) FILTER (vintage<>v) AS sd, count(*) AS n FROM av, mx GROUP BY 1 HAVING count(*)>=10 AND max(r) FILTER (vintage=v) IS NOT NULL),
   seg AS (SELECT CAST(date_trunc('month',o_orderdate) AS DATE) AS date, c_mktsegment AS entity, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2), {lz('o','SELECT * FROM seg')},
   z AS (SELECT s.*, (cur-m)/sd AS rev, o.z AS mom FROM s JOIN o USING (entity))
   SELECT 'D3' AS detector, 'A3' AS archetype, entity, CASE WHEN rev>=0.1 AND mom<9 THEN 'long' ELSE 'short' END AS direction, round(rev,2) AS severity, cur AS revision, rev AS revision_z, mom AS momentum_z FROM z WHERE (rev>=0.1 AND mom<9) OR (rev<=-0.1 AND mom>-9)""", "severity revision revision_z momentum_z", digits=4)
def _(t):
    rv = X.vintage_revisions(vintages(t).filter("variable = 'F'")).filter("vintage <= date'2001-05-01'").select("vintage", "entity", "revision")
    seg = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.trunc("o_orderdate", "month").alias("date"), F.col("c_mktsegment").alias("entity")).agg(F.sum("o_totalprice").alias("value"))
    return show(D.d3_revision_momentum(rv, seg, 10, 0.1, 9.0, 60, 24), "revision", "revision_z", "momentum_z")


@query("D4_cross_asset", f"""WITH {lz('e',tr(3))}, {lz('fx',chg(2,'A','rel',-1))}, {lz('y',chg(2,'N'))}, {lz('c',chg(2,'R'))},
   j AS (SELECT e.entity, e.z*2 AS eq, fx.z*2 AS fx, y.z*2 AS y, c.z*2 AS cds FROM e LEFT JOIN fx USING (entity) LEFT JOIN y USING (entity) LEFT JOIN c USING (entity)),
   f AS (SELECT *, list_filter([CASE WHEN eq>=1 AND fx<=-1 THEN {{'a':abs(fx),'k':'fx_weak_vs_equity_strong'}} END, CASE WHEN eq<=-1 AND fx>=1 THEN {{'a':abs(fx),'k':'fx_strong_vs_equity_weak'}} END, CASE WHEN eq>=1 AND y>=1.5 THEN {{'a':abs(y),'k':'yields_spiking_vs_equity_strong'}} END,
     CASE WHEN eq>=1 AND cds>=1.5 THEN {{'a':abs(cds),'k':'credit_widening_vs_equity_strong'}} END, CASE WHEN eq<=-1 AND cds<=-1.5 THEN {{'a':abs(cds),'k':'credit_tightening_vs_equity_weak'}} END], lambda x: x IS NOT NULL) AS l FROM j)
   SELECT 'D4' AS detector, 'A4' AS archetype, entity, 'flag' AS direction, round(least(abs(eq), list_max(l).a)*sign(eq),2) AS severity, eq AS equity_z, fx AS fx_z, list_max(l).k AS conflict FROM f WHERE len(l)>0""", "severity equity_z fx_z")
def _(t):
    d2 = lambda d, n: d.withColumn(n, F.col(n) * 2)  # thin test panels: widen the z's
    eq = d2(D.z_of(own(t), "value", "eq", 60, 24), "eq")
    fx = d2(D.change_z(level(t, "A"), 2, "fx", "relative", -1.0, 60, 24), "fx")
    y = d2(D.change_z(level(t, "N"), 2, "y", window=60, minimum=24), "y")
    c = d2(D.change_z(level(t, "R"), 2, "cds", window=60, minimum=24), "cds")
    r = D.d4_cross_asset(eq, fx, y, c)
    return r.select("detector", "archetype", "entity", "direction", "severity", F.col("components")["equity_z"].alias("equity_z"), F.col("components")["fx_z"].alias("fx_z"), "conflict")


@query("D5_attention", f"""WITH z AS (SELECT entity, date, variable, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS value FROM {{monthly}} WINDOW g AS (PARTITION BY date, variable)), a AS (SELECT entity, arg_max(value,date) AS att, max(date) AS d FROM z WHERE variable='A' AND date<='2001-06-01' GROUP BY 1), tn AS (SELECT entity, arg_max(value,date) AS tone FROM z WHERE variable='N' GROUP BY 1), {lz('o',tr(3))}
   SELECT 'D5' AS detector, 'A5' AS archetype, a.entity, 'flag' AS direction, round(att,2) AS severity, att AS attention_z, o.z AS own_z, tone AS tone_z FROM a JOIN o ON o.entity=a.entity LEFT JOIN tn ON tn.entity=a.entity WHERE DATE '2001-06-05'-a.d<=7 AND att>=0.5 AND abs(o.z)<=2""", "severity attention_z own_z tone_z")
def _(t):
    z = cross_z(B.monthly(t)).select("entity", "date", "variable", F.col("z").alias("value"))
    a = z.filter("variable = 'A' AND date <= date'2001-06-01'")
    return show(D.d5_attention(a, z.filter("variable = 'N'"), own(t), "2001-06-05", 7, 0.5, 2.0, 60, 24), "attention_z", "own_z", "tone_z")


@query("D7_crowding", f"""WITH dp AS (SELECT variable AS entity, date, stddev_samp(value) AS value FROM {{monthly}} GROUP BY 1,2), {lz('z','SELECT * FROM dp')}
   SELECT 'D7' AS detector, 'A7' AS archetype, entity, 'flag' AS direction, round(z,2) AS severity, z AS dispersion_z FROM z WHERE z <= 9 ORDER BY z, entity LIMIT 2""", "severity dispersion_z")
def _(t):
    fr = B.mret(t).select(F.col("entity").alias("factor"), "date", F.col("ret").alias("value"))
    d = D.d7_crowding(B.monthly(t), fr, 9.0, 2, 99.0, 12, 60, 24)
    return show(d, "dispersion_z")


@query("D8_stewardship", f"""WITH {lz('o',tr(3))}, hd AS (SELECT n_name AS entity, (n_nationkey+1)/100.0 AS weight FROM nation) SELECT 'D8' AS detector, 'stewardship' AS archetype, entity, 'flag' AS direction, 0.0 AS severity, NULL::DOUBLE AS days_open, weight, z AS own_z FROM hd LEFT JOIN o USING (entity)
   UNION ALL SELECT 'D8','stewardship', o_orderkey::VARCHAR, 'flag', 0.0, (o_orderkey%90)::DOUBLE, NULL, NULL FROM orders WHERE o_orderstatus='O'""", "severity days_open weight own_z")
def _(t):
    hd = t.nation.select(F.lit("2001-06-30").cast("date").alias("date"), F.col("n_name").alias("entity"), ((F.col("n_nationkey") + 1) / 100).alias("weight"))
    th = t.orders.select(F.col("o_orderkey").cast("string").alias("entity"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("hit").alias("status"), F.lit(0.0).alias("cum_return"), (F.col("o_orderkey") % 90).alias("days_open"), F.lit(63).alias("horizon_days"), F.lit(-0.07).alias("invalidation"))
    return show(D.d8_stewardship(th, hd, own(t), 60, 24), "days_open", "weight", "own_z")


BASIS = """b AS (SELECT a.entity, a.date, CASE WHEN count(*) OVER f=5 THEN (exp(sum(ln(1+a.ret)) OVER f)-1) - (exp(sum(ln(1+b.ret)) OVER f)-1) END AS value FROM {mret} a JOIN (SELECT date, entity, ret*0.9-0.001 AS ret FROM mret WHERE month(date)<>2) b ON a.entity=b.entity AND a.date=b.date WINDOW f AS (PARTITION BY a.entity ORDER BY a.date ROWS 4 PRECEDING))"""


@query("D9_basis", f"""WITH {BASIS}, s AS (SELECT entity, arg_max(value,date) AS gap, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n_obs FROM b WHERE value IS NOT NULL GROUP BY 1)
   SELECT 'D9' AS detector, 'basis' AS archetype, entity, 'flag' AS direction, round((gap-m)/sd,2) AS severity, gap, (gap-m)/sd AS gap_z, n_obs::DOUBLE AS n_obs FROM s WHERE abs((gap-m)/sd)>=0.7""", "severity gap gap_z n_obs")
def _(t):
    a = B.mret(t)
    b = a.filter("month(date) <> 2").withColumn("ret", F.col("ret") * 0.9 - 0.001)
    return show(D.d9_basis(a, b, "2001-08-01", 60, 5, 50, 0.7), "gap", "gap_z", "n_obs")


@query("D10_options", f"""WITH z AS (SELECT entity, date, variable, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS value FROM {{monthly}} WINDOW g AS (PARTITION BY date, variable)), r AS (SELECT entity, arg_max(value,date) AS rr FROM z WHERE variable='A' GROUP BY 1), i AS (SELECT entity, arg_max(value,date) AS iv FROM z WHERE variable='N' GROUP BY 1),
   {lz('a',tr(2))}, {lz('b',tr(6))}, j AS (SELECT r.entity, rr, iv, a.z AS e5, b.z AS e21 FROM r LEFT JOIN i ON i.entity=r.entity LEFT JOIN a ON a.entity=r.entity LEFT JOIN b ON b.entity=r.entity),
   k AS (SELECT *, CASE WHEN (rr>=0.8 OR coalesce(iv>=1.5,false)) AND abs(e21)<=1 THEN 'options_stress_unpriced' WHEN e5<=-0.3 AND rr<=0.5 AND iv<=0.5 THEN 'equity_stress_unconfirmed' END AS c FROM j)
   SELECT 'D10' AS detector, 'A10' AS archetype, entity, 'flag' AS direction, round(CASE WHEN c='options_stress_unpriced' THEN greatest(rr,iv) ELSE e5 END,2) AS severity, rr AS rr_z, iv AS iv_z, e5 AS equity_5_z, e21 AS equity_21_z FROM k WHERE c IS NOT NULL""", "severity rr_z iv_z equity_5_z equity_21_z")
def _(t):
    z = cross_z(B.monthly(t)).select("entity", "date", "variable", F.col("z").alias("value"))
    d = D.d10_options(z.filter("variable = 'A'"), z.filter("variable = 'N'"), own(t, 2), own(t, 6), 0.8, 1.5, 1.0, -0.3, 0.5, 60, 24)
    return show(d, "rr_z", "iv_z", "equity_5_z", "equity_21_z")


@query("D11_staleness_degraded", """WITH l AS (SELECT entity, max(date) AS d FROM (SELECT *, lag(v) OVER (PARTITION BY entity ORDER BY date) AS p FROM (SELECT date, entity, round(value/1e6,0) AS v FROM {monthly} WHERE variable='R')) WHERE p IS NULL OR p<>v GROUP BY 1), a AS (SELECT n_name AS entity, DATE '2001-12-01'-d AS age, coalesce(DATE '2001-12-01'-d>70,true) AS stale FROM nation LEFT JOIN l ON entity=n_name)
   SELECT 'D11' AS detector, 'degraded' AS archetype, 'D11_INPUTS:LEVELS' AS entity, 'flag' AS direction, 0.0 AS severity, count(*)::DOUBLE AS n_affected, max(age)::DOUBLE AS worst_age FROM a WHERE stale""", "severity n_affected worst_age")
def _(t):
    lv = level(t, "R").withColumn("value", F.round(F.col("value") / 1e6, 0))
    s = D.staleness(lv, "2001-12-01", 70, t.nation.select(F.col("n_name").alias("entity")))
    return show(D.degraded(s, "D11", "LEVELS"), "n_affected", "worst_age")


Z = "(SELECT entity, date, variable, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS z FROM {monthly} WINDOW g AS (PARTITION BY date, variable))"


def zed(t):
    return cross_z(B.monthly(t)).select("entity", "date", "variable", "z")


def today_prev(t):
    z = zed(t).filter(F.abs("z") >= 0.6)
    det = lambda m: z.filter(F.col("date") == F.lit(m).cast("date")).select(F.concat(F.lit("D"), "variable").alias("detector"), "entity", F.when(F.col("z") > 0, "long").otherwise("short").alias("direction"), F.round("z", 4).alias("severity"))
    prev = det("2001-04-01").withColumns({"status": F.when(F.col("entity") == "NATION_1", "resolved").otherwise("persisting"), "first_seen": F.lit("2001-03-01").cast("date"), "days_active": F.lit(5).cast("long"), "dislocation_id": F.concat_ws("-", "detector", "entity")})
    return det("2001-05-01"), prev


@query("D12_merge_state", f"""WITH t AS (SELECT 'D'||variable AS detector, entity, CASE WHEN z>0 THEN 'long' ELSE 'short' END AS direction, round(z,4) AS severity FROM {Z} WHERE abs(z)>=0.6 AND date='2001-05-01'), p AS (SELECT 'D'||variable AS detector, entity, CASE WHEN z>0 THEN 'long' ELSE 'short' END AS pd, round(z,4) AS ps FROM {Z} WHERE abs(z)>=0.6 AND date='2001-04-01' AND entity<>'NATION_1'),
   j AS (SELECT coalesce(t.detector,p.detector) AS detector, coalesce(t.entity,p.entity) AS entity, t.direction, severity, pd, ps FROM t FULL JOIN p ON t.detector=p.detector AND t.entity=p.entity), m AS (SELECT j.*, ret AS move FROM j LEFT JOIN {{mret}} r ON r.entity=j.entity AND r.date='2001-05-01')
   SELECT DATE '2001-05-01' AS date, CASE WHEN ps IS NOT NULL THEN detector||'-'||entity ELSE 'new' END AS dislocation_id, detector, entity, coalesce(direction,pd) AS direction, coalesce(severity,0.0) AS severity,
    CASE WHEN ps IS NULL THEN 'new' WHEN severity IS NULL THEN 'resolved' WHEN abs(severity)>=1.2*abs(ps) THEN 'intensifying' WHEN abs(severity)<=0.8*abs(ps) THEN 'fading' ELSE 'persisting' END AS status, CASE WHEN ps IS NULL THEN DATE '2001-05-01' ELSE DATE '2001-03-01' END AS first_seen,
    CASE WHEN severity IS NULL THEN 5 WHEN ps IS NOT NULL THEN 6 ELSE 1 END::BIGINT AS days_active, CASE WHEN severity IS NULL THEN CASE WHEN move IS NULL THEN 'condition_cleared' WHEN abs(move)<0.01 THEN 'decayed' WHEN (move>0)=(pd='long') THEN 'repriced_with' ELSE 'repriced_against' END END AS resolution_note FROM m""", "severity", digits=4)
def _(t):
    now, prev = today_prev(t)
    mv = B.mret(t).filter("date = date'2001-05-01'").select("entity", F.col("ret").alias("move"))
    d = D.merge_state(now, prev, "2001-05-01", mv)
    return d.withColumn("dislocation_id", F.when(F.col("status") == "new", "new").otherwise(F.col("dislocation_id")))


@query("D13_trigger_lists", f"""WITH l AS (SELECT *, lag(z) OVER (PARTITION BY entity, variable ORDER BY date) AS p FROM {Z}),
   d AS (SELECT entity, date, CASE variable WHEN 'N' THEN 'D8' ELSE variable END AS name, z, CASE WHEN coalesce(abs(p),0) < 1 THEN 'new' WHEN abs(z) >= 1.2*abs(p) THEN 'intensifying' ELSE 'persisting' END AS status FROM l WHERE abs(z) >= 1),
   t AS (SELECT entity, date, 'detector' AS kind, name, round(z,6) AS severity FROM d WHERE status <> 'persisting' AND name <> 'D8'
     UNION ALL SELECT r.entity, m.date, 'event', 'drop', NULL FROM {{mret}} r JOIN (SELECT DISTINCT date FROM d) m ON abs(date_diff('day', r.date, m.date)) <= 2 WHERE ret < -0.03)
   SELECT *, row_number() OVER (PARTITION BY entity, date ORDER BY kind, abs(severity) DESC NULLS LAST, name) AS position FROM t""", "severity")
def _(t):
    prev = F.lag("z").over(Window.partitionBy("entity", "variable").orderBy("date"))
    det = zed(t).withColumn("_p", prev).filter(F.abs("z") >= 1)
    det = det.select(
        "entity", "date", F.when(F.col("variable") == "N", "D8").otherwise(F.col("variable")).alias("detector"), F.round("z", 6).alias("severity"),
        F.when(F.coalesce(F.abs("_p"), F.lit(0.0)) < 1, "new").when(F.abs("z") >= 1.2 * F.abs("_p"), "intensifying").otherwise("persisting").alias("status"))
    ev = B.mret(t).filter("ret < -0.03").select("entity", F.col("date").alias("event_date"), F.lit("drop").alias("name"))
    return D.triggers(det, ev)


# --- episodes -----------------------------------------------------------------------------

def candidates(t):
    """z rows of one month as scored detections."""
    k = F.col("n_nationkey")
    d = zed(t).filter("date = date'2001-03-01' AND z IS NOT NULL").join(t.nation.select(F.col("n_name").alias("entity"), "n_nationkey"), "entity")
    det = d.select(
        F.concat(F.lit("D"), "variable").alias("detector"), "entity", F.when(F.col("z") > 0, "long").otherwise("short").alias("direction"), F.round(F.col("z") * 2, 4).alias("severity"),
        F.when(k % 4 == 0, "new").when(k % 4 == 1, "intensifying").when(k % 4 == 2, "persisting").otherwise("fading").alias("status"), (k * 3).cast("long").alias("days_active"),
        F.when(F.col("variable") == "A", "G2").when(F.col("variable") == "N", "G3").otherwise("G6").alias("gap_class"), F.lit("21d").alias("horizon"), F.lit(0.55).alias("prior"), F.lit("A").alias("archetype"))
    price = t.nation.filter("n_nationkey % 6 <> 5").select(
        F.col("n_name").alias("entity"), F.when(k % 7 == 6, None).otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("ticker"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").otherwise("micro").alias("liquidity"),
        (k / 10).alias("basis_z"), F.when(k % 2 == 0, k / 12).alias("crowding_z"), (k * 2.0).alias("expense_bps"))
    return det, price


CAND = f"""det AS (SELECT 'D'||variable AS detector, z.entity, CASE WHEN z>0 THEN 'long' ELSE 'short' END AS direction, round(z*2,4) AS severity, CASE k%4 WHEN 0 THEN 'new' WHEN 1 THEN 'intensifying' WHEN 2 THEN 'persisting' ELSE 'fading' END AS status, k*3 AS days_active,
     CASE variable WHEN 'A' THEN 'G2' WHEN 'N' THEN 'G3' ELSE 'G6' END AS gap_class, k FROM {Z} z JOIN (SELECT n_name, n_nationkey::BIGINT AS k FROM nation) ON n_name=z.entity WHERE date='2001-03-01' AND z IS NOT NULL),
   sc AS (SELECT *, k%6<>5 AS has, least(1,abs(severity)/3) AS s1, CASE status WHEN 'new' THEN 1 WHEN 'intensifying' THEN 0.9 WHEN 'persisting' THEN 0.55 ELSE 0.3 END AS s2,
     CASE WHEN k%6=5 OR k%7=6 THEN 0.10 ELSE greatest(0,CASE k%3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.55 ELSE 0.25 END - least(0.3,k/100.0)) END AS q, CASE WHEN k%6=5 THEN 0 ELSE least(1,k*2/100.0) END AS dr,
     CASE WHEN k%6=5 THEN 0.2 WHEN k%2=1 THEN 0.15 ELSE least(1,k/36.0) END AS cr, least(1,greatest(0,k*3-5)/58.0) AS st FROM det),
   tn AS (SELECT *, greatest(0,least(1,0.28*s1+0.12*s2+0.10*0.55+0.14*q+0.08*0.35-0.05*dr-0.08*cr-0.08*st-0.07*CASE WHEN q>=0.25 THEN 0 ELSE 0.8 END)) AS tension FROM sc)"""


@query("E1_score_candidates", f"WITH {CAND} SELECT detector, entity, severity, s1 AS severity_score, s2 AS novelty_score, q AS expression_score, dr AS drag_score, cr AS crowding_score, st AS staleness_score, tension FROM tn", "severity severity_score novelty_score expression_score drag_score crowding_score staleness_score tension")
def _(t):
    s = E.score_candidates(*candidates(t))
    return s.select("detector", "entity", "severity", "severity_score", "novelty_score", "expression_score", "drag_score", "crowding_score", "staleness_score", "tension")


def promoted(t):
    s = E.score_candidates(*candidates(t))
    key = F.concat_ws("|", "entity", "gap_class", "direction", "horizon")
    op = s.filter("entity IN ('NATION_0','NATION_4')").select(key.alias("episode_key"), F.concat(F.lit("open-"), "entity").alias("gap_id")).distinct()
    hist = op.select("episode_key", F.lit(2).alias("episode_instance"))
    return E.promote(s, op, hist, "2001-03-01", t.nation.select(F.col("n_name").alias("entity")))


PROM = f"{CAND}, pr AS (SELECT *, entity||'|'||gap_class||'|'||direction||'|21d' AS episode_key, abs(severity)>=1 AND has AS eligible, gap_class='G6' AS research_only, abs(severity)>=1 AND has AND gap_class<>'G6' AND tension>=0.35 AS promoted, entity IN ('NATION_0','NATION_4') AS op FROM tn)"


@query("E2_promote", f"""WITH {PROM} SELECT detector, entity, episode_key, eligible, research_only, promoted, CASE WHEN promoted THEN CASE WHEN op THEN 'open-'||entity ELSE substr(sha1(episode_key||'|2001-03-01|1'),1,20) END END AS gap_id, promoted AND NOT op AS opens,
   CASE WHEN promoted AND NOT op THEN 1 END::BIGINT AS episode_instance, CASE WHEN NOT promoted THEN CASE WHEN research_only THEN 'research_only' ELSE 'below_threshold_or_ineligible' END END AS reason_not_promoted FROM pr""")
def _(t):
    return promoted(t).select("detector", "entity", "episode_key", "eligible", "research_only", "promoted", "gap_id", "opens", "episode_instance", "reason_not_promoted")


@query("E2_expression_rows", f"""WITH {PROM}, o AS (SELECT substr(sha1(episode_key||'|2001-03-01|1'),1,20) AS gap_id, entity, k FROM pr WHERE promoted AND NOT op) SELECT gap_id, entity, 'T'||k::VARCHAR AS ticker, true AS is_primary FROM o UNION ALL SELECT gap_id, entity, 'ALT', false FROM o""")
def _(t):
    tk = t.nation.select(F.col("n_name").alias("entity"), F.array(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")), F.lit("ALT"), F.lit("ALT")).alias("tickers"))
    return E.expression_rows(promoted(t), tk)


@query("E5_shadow_score", """SELECT o_orderkey, CAST('0x'||substr(sha1(o_orderkey::VARCHAR||'|shadow_v1'),1,13) AS BIGINT)/4503599627370496.0 AS shadow FROM orders""", "shadow")
def _(t):
    return t.orders.select("o_orderkey", E.shadow_score(F.col("o_orderkey").cast("string")).alias("shadow"))


@query("E11_signature_stable", """SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem)""")
def _(t):
    c = F.create_map(F.lit("q"), F.col("l_quantity"), F.lit("t"), F.col("l_tax"))
    s = t.lineitem.select(E.signature(c, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sig"))
    return s.distinct().agg(F.count("*").alias("n"))


def episodes_open(t):
    """One long or short episode per nation, opened on different days."""
    k = F.col("n_nationkey")
    return t.nation.select(
        F.col("n_name").alias("gap_id"), F.col("n_name").alias("entity"), F.when(k % 2 == 0, "long").otherwise("short").alias("direction"), F.date_sub(F.lit("2001-06-01").cast("date"), k * 4).alias("first_seen"),
        E.expected_move(F.concat(F.lit("G"), (k % 8 + 1).cast("string")), F.when(k % 3 == 0, "5d").otherwise("21d"), (k - 12) / 4.0, F.when(k % 2 == 0, "long").otherwise("short")).alias("expected_move"),
        (k / 25).alias("severity_score"), F.lit(0.55).alias("novelty_score"), F.lit(0.5).alias("prior_score"), (k / 50).alias("drag_score"), F.lit("open").alias("status"), F.lit(None).cast("date").alias("closed_at"), F.lit(None).cast("string").alias("close_reason"))


def price_now(t):
    r = B.mret(t).filter("date = date'2001-05-01' AND entity <> 'NATION_2'")
    k = F.col("n_nationkey")
    return r.join(t.nation.select(F.col("n_name").alias("entity"), "n_nationkey"), "entity").select(
        "entity", "ret", F.when(k % 3 == 0, "high").otherwise("low").alias("liquidity"), (k / 10).alias("basis_z"), F.lit("T").alias("ticker"), F.when(k % 2 == 0, k / 12).alias("crowding_z"))


_BASE = " ".join(f"WHEN {i} THEN (CASE WHEN k%3=0 THEN {E.EXPECTED_MOVE[f'G{i+1}'][0]} ELSE {E.EXPECTED_MOVE[f'G{i+1}'][1]} END)" for i in range(8))
MARK = f"""ep AS (SELECT n_name AS entity, n_nationkey::BIGINT AS k, CASE WHEN n_nationkey%2=0 THEN 1 ELSE -1 END AS s FROM nation), x AS (SELECT ep.*, s*(CASE k%8 {_BASE} END)*greatest(0.5,least(2.0,abs((k-12)/4.0)/2)) AS em, k*4+1 AS age, r.ret FROM ep LEFT JOIN (SELECT * FROM {{mret}} WHERE date='2001-05-01' AND entity<>'NATION_2') r USING (entity)),
   i AS (SELECT *, s*ret AS realized, CASE WHEN abs(em)>=0.005 AND ret IS NOT NULL THEN greatest(-2,least(2,s*ret/greatest(abs(em),0.005))) END AS idx FROM x),
   s0 AS (SELECT *, CASE WHEN idx IS NULL THEN 'insufficient_signal' WHEN idx < -0.25 THEN 'repriced_against' WHEN idx<0.25 THEN 'unabsorbed' WHEN idx<0.75 THEN 'partially_absorbed' ELSE 'absorbed' END AS st0 FROM i),
   cl AS (SELECT *, CASE WHEN age>63 AND st0 IN ('unabsorbed','insufficient_signal') THEN 'max_age_unabsorbed' WHEN age>63 AND st0='repriced_against' THEN 'max_age_repriced_against' WHEN st0='absorbed' THEN 'absorbed' END AS close_reason,
      CASE WHEN ret IS NULL THEN 0.1 ELSE greatest(0,CASE WHEN k%3=0 THEN 0.95 ELSE 0.55 END-least(0.3,k/100.0)) END AS q, CASE WHEN ret IS NULL THEN 0.2 WHEN k%2=1 THEN 0.15 ELSE least(1,k/36.0) END AS cr, least(1,greatest(0,age-5)/58.0) AS sp FROM s0),
   bs AS (SELECT *, CASE WHEN close_reason='max_age_unabsorbed' THEN 'decayed' ELSE st0 END AS state, greatest(0,least(1,0.28*k/25.0+0.12*0.55+0.10*0.5+0.08*0.35-0.05*k/50.0+0.14*q-0.08*cr-0.08*sp-0.07*CASE WHEN q>=0.25 THEN 0 ELSE 0.8 END)) AS b FROM cl),
   mk AS (SELECT *, CASE WHEN state='repriced_against' THEN least(b,0.3)*(1-least(1,abs(coalesce(idx,0)))) WHEN state IN ('partially_absorbed','absorbed','decayed') THEN b*greatest(0,least(1,1-coalesce(idx,0))) ELSE b END AS tension_now FROM bs)"""


@query("E3_E4_mark_episodes", f"""WITH {MARK} SELECT entity AS gap_id, entity, DATE '2001-06-01' AS date, realized, em AS expected_move, idx AS absorption_index, CASE WHEN idx IS NOT NULL THEN greatest(0,least(1,1-idx)) END AS unabsorbed, state, tension_now, age AS days_active, close_reason,
   CASE close_reason WHEN 'max_age_unabsorbed' THEN 'unresolved_decay' WHEN 'max_age_repriced_against' THEN 'falsified' WHEN 'absorbed' THEN 'success_with_absorption' END AS outcome FROM mk""", "realized expected_move absorption_index unabsorbed tension_now")
def _(t):
    return E.mark(episodes_open(t), price_now(t), "2001-06-01")


@query("E4_close_episodes", f"""WITH {MARK} SELECT entity AS gap_id, CASE WHEN close_reason='max_age_unabsorbed' THEN 'expired' WHEN close_reason IS NOT NULL THEN 'closed' ELSE 'open' END AS status, CASE WHEN close_reason IS NOT NULL THEN DATE '2001-06-01' END AS closed_at, close_reason FROM mk""")
def _(t):
    ep = episodes_open(t)
    return E.close_episodes(ep, E.mark(ep, price_now(t), "2001-06-01")).select("gap_id", "status", "closed_at", "close_reason")


@query("E12_latest_gap_lists", f"""WITH {MARK} SELECT entity AS gap_id, entity, CASE WHEN s=1 THEN 'long' ELSE 'short' END AS direction, state, tension_now, idx AS absorption_index FROM mk WHERE state IN ('repriced_against','unabsorbed') ORDER BY tension_now DESC, gap_id LIMIT 8""", "tension_now absorption_index")
def _(t):
    ep = episodes_open(t)
    return E.latest_gap_lists(ep, E.mark(ep, price_now(t), "2001-06-01"), "2001-06-01", ["repriced_against", "unabsorbed"], 8)


def level_prices(t):
    lvl = B.sales(t).filter("month(date) <> 5 OR entity <> 'NATION_3'")
    return lvl.select("date", F.col("entity").alias("ticker"), F.col("value").alias("close"))


def score_episodes(t):
    k = F.col("o_orderkey")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("gap_id"), F.col("n_name").alias("entity"), F.when(k % 2 == 0, "long").otherwise("short").alias("direction"), F.to_date("o_orderdate").alias("opened"),
        F.when(k % 3 == 0, 1).otherwise(3).alias("horizon_days"), F.when(k % 11 != 0, F.col("n_name")).alias("ticker"))


OUT = """px AS (SELECT date, entity AS ticker, value AS close FROM {sales} WHERE month(date)<>5 OR entity<>'NATION_3'), cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM px)),
   ep AS (SELECT o_orderkey AS gap_id, n_name AS entity, CASE WHEN o_orderkey%2=0 THEN 'long' ELSE 'short' END AS direction, CAST(o_orderdate AS DATE) AS opened, CASE WHEN o_orderkey%3=0 THEN 1 ELSE 3 END AS horizon_days, CASE WHEN o_orderkey%11<>0 THEN n_name END AS ticker FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey),
   e1 AS (SELECT ep.*, (SELECT min(i) FROM cal WHERE cal.date>opened) AS e FROM ep), e2 AS (SELECT *, e+horizon_days AS x, coalesce(e+horizon_days <= (SELECT max(i) FROM cal), false) AS matured FROM e1), pi AS (SELECT ticker, i, close FROM px JOIN cal USING (date)),
   wn AS (SELECT a.ticker, a.i AS e, b.i AS x, b.close/a.close-1 AS r FROM pi a JOIN pi b ON a.ticker=b.ticker AND b.i-a.i IN (1,3)), ew AS (SELECT e, x, avg(r) AS r_ew FROM wn GROUP BY 1,2),
   e3 AS (SELECT e2.*, wn.r AS r_inst0, ew.r_ew AS r_ew0, c1.date AS entry, c2.date AS exit FROM e2 LEFT JOIN wn ON wn.ticker=e2.ticker AND wn.e=e2.e AND wn.x=e2.x LEFT JOIN ew ON ew.e=e2.e AND ew.x=e2.x LEFT JOIN cal c1 ON c1.i=e2.e LEFT JOIN cal c2 ON c2.i=e2.x),
   cx AS (SELECT entity, date, sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date) AS cum FROM {mret}),
   e4 AS (SELECT e3.*, exp(b.cum-coalesce(a.cum,0))-1 AS r_idx0 FROM e3 LEFT JOIN cx a ON a.entity=e3.entity AND a.date=e3.entry LEFT JOIN cx b ON b.entity=e3.entity AND b.date=e3.exit),
   e5 AS (SELECT *, CASE WHEN direction='long' THEN 1 ELSE -1 END AS d, CASE WHEN ticker IS NULL THEN 'no_expression' WHEN NOT matured THEN 'pending' WHEN r_inst0 IS NULL OR r_ew0 IS NULL THEN 'no_price_history' ELSE 'scored' END AS status FROM e4),
   oc AS (SELECT gap_id, entity, direction, ticker, opened, horizon_days, entry, exit, status, CASE WHEN status='scored' THEN r_inst0 END AS r_inst, CASE WHEN status='scored' THEN r_ew0 END AS r_ew, CASE WHEN status='scored' THEN r_idx0 END AS r_index,
     CASE WHEN status='scored' THEN d*(r_inst0-r_ew0) END AS gross_active, CASE WHEN status='scored' THEN d*(r_inst0-r_idx0) END AS capture, CASE WHEN status='scored' THEN d*(r_idx0-r_ew0) END AS information, CASE WHEN status='scored' THEN d*(r_inst0-r_ew0)-0.005 END AS net_active FROM e5)"""


def outcomes(t):
    return E.score_outcomes(score_episodes(t), level_prices(t), B.mret(t))


@query("E6_score_outcomes", f"WITH {OUT} SELECT * FROM oc", "r_inst r_ew r_index gross_active capture information net_active")
def _(t):
    return outcomes(t)


@query("E7_classify_outcomes", f"""WITH {OUT}, dz AS (SELECT date, entity, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS z FROM sales WINDOW g AS (PARTITION BY date)), o1 AS (SELECT oc.*, z.z AS bz0, z.date AS bd FROM oc ASOF LEFT JOIN dz z ON oc.entity=z.entity AND oc.opened>=z.date), o2 AS (SELECT o1.*, z.z AS fz0, z.date AS fd FROM o1 ASOF LEFT JOIN dz z ON o1.entity=z.entity AND o1.opened<=z.date),
   o3 AS (SELECT o2.*, CASE WHEN bd IS NULL OR fd-opened < opened-bd THEN fz0 ELSE bz0 END AS z0, z.z AS z1 FROM o2 ASOF LEFT JOIN dz z ON z.entity=o2.entity AND o2.exit>=z.date),
   v AS (SELECT *, CASE WHEN exit IS NULL OR z0 IS NULL OR z1 IS NULL OR abs(z0)<1e-9 THEN 'unknown' WHEN abs(z1)<0.5*abs(z0) THEN 'revised_away' ELSE 'confirmed' END AS data_validity, CASE gap_id%4 WHEN 0 THEN NULL WHEN 1 THEN entry ELSE exit + (gap_id%3-1)::INT END AS absorbed_at FROM o3),
   a AS (SELECT *, CASE WHEN gross_active>0.005 THEN 'with_thesis' WHEN gross_active < -0.005 THEN 'against_thesis' ELSE 'unresolved' END AS price_response, CASE WHEN absorbed_at IS NULL THEN 'no_absorption' WHEN absorbed_at<=entry THEN 'pre_absorbed' ELSE 'tradable' END AS timing,
     CASE WHEN information IS NULL OR capture IS NULL THEN 'unknown' WHEN information>0.005 AND capture < -0.005 THEN 'basis_failure' ELSE 'captured' END AS expression, CASE WHEN net_active>0 THEN 'positive_net' ELSE 'negative_net' END AS economics, CASE WHEN absorbed_at IS NULL THEN 'unresolved' WHEN absorbed_at<=exit THEN 'on_time' ELSE 'late' END AS horizon_fit FROM v)
   SELECT gap_id, data_validity, price_response, timing, expression, economics, horizon_fit, CASE WHEN price_response='unresolved' THEN 'UNRESOLVED' WHEN price_response='against_thesis' OR data_validity='revised_away' THEN 'DATA_WRONG' WHEN timing='pre_absorbed' THEN 'DATA_RIGHT_ALREADY_ABSORBED' WHEN economics='negative_net' THEN 'DATA_RIGHT_NOT_CAPTURABLE' ELSE 'DATA_RIGHT_CAPTURED' END AS headline FROM a""")
def _(t):
    det = cross_z(B.sales(t)).select("date", "entity", F.col("z").alias("severity"))
    k = F.col("gap_id")
    ab = F.when(k % 4 == 1, F.col("entry")).when(k % 4 != 0, F.date_add("exit", (k % 3 - 1).cast("int")))
    o = E.signal_persistence(outcomes(t), det).withColumn("absorbed_at", ab)
    return E.classify(o).select("gap_id", "data_validity", "price_response", "timing", "expression", "economics", "horizon_fit", "headline")


@query("E8_mark_theses", """WITH th AS (SELECT o_orderkey AS thesis_id, n_name AS entity, CASE WHEN o_orderkey%2=0 THEN 'long' ELSE 'short' END AS direction, CAST(o_orderdate AS DATE) AS od, 400 AS h, -0.03 AS inv FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey),
   c AS (SELECT thesis_id, any_value(th.entity) AS entity, any_value(direction) AS direction, max(date) AS mark_date, round(exp(sum(ln(1+CASE WHEN direction='long' THEN ret ELSE -ret END)))-1,6) AS cum_return, max(date)-any_value(od) AS days_open, any_value(inv) AS inv, any_value(h) AS h FROM th JOIN {mret} m ON m.entity=th.entity AND m.date>od GROUP BY 1)
   SELECT thesis_id, entity, direction, mark_date, cum_return, days_open, CASE WHEN cum_return<=inv THEN 'invalidated' WHEN days_open>=h THEN CASE WHEN cum_return>0 THEN 'hit' ELSE 'miss' END ELSE 'open' END AS status FROM c""", "cum_return")
def _(t):
    s = score_episodes(t).select(F.col("gap_id").alias("thesis_id"), "entity", "direction", F.col("opened").alias("open_date"), F.lit(400).alias("horizon_days"), F.lit(-0.03).alias("invalidation"))
    return E.mark_theses(s, B.mret(t))


@query("E9_forward_track", """WITH st AS (SELECT n_name AS entity, make_date(1996+n_nationkey%5,3,15) AS start FROM nation), r AS (SELECT entity, date, sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s, count(*) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c FROM {mret}),
   f AS (SELECT d.start, r.entity, min(r.date) AS first_date FROM (SELECT DISTINCT start FROM st) d JOIN r ON r.date>d.start GROUP BY 1,2), h AS (SELECT f.*, exp(s)-1 AS cum_return FROM f JOIN r ON r.entity=f.entity AND r.date=f.first_date WHERE c=6), x AS (SELECT start, avg(cum_return) AS xs_mean, count(*) AS n_entities FROM h GROUP BY 1)
   SELECT st.entity, st.start, first_date, cum_return, xs_mean, n_entities, cum_return-xs_mean AS relative FROM st JOIN h ON h.entity=st.entity AND h.start=st.start JOIN x ON x.start=st.start""", "cum_return xs_mean relative")
def _(t):
    st = t.nation.select(F.col("n_name").alias("entity"), F.make_date(1996 + F.col("n_nationkey") % 5, F.lit(3), F.lit(15)).alias("start"))
    return E.forward_track(st, B.mret(t), 6)


@query("E10_family_ranks", """SELECT date, entity, 'SALES' AS variable, row_number() OVER (PARTITION BY date ORDER BY value DESC, entity)::DOUBLE AS value FROM {sales} QUALIFY count(*) OVER (PARTITION BY date)>=5 UNION ALL SELECT date, entity, 'REV_A', row_number() OVER (PARTITION BY date ORDER BY value, entity)::DOUBLE FROM {monthly} WHERE variable='A' QUALIFY count(*) OVER (PARTITION BY date)>=5""", "value")
def _(t):
    return E.family_ranks([("SALES", B.sales(t), True), ("REV_A", B.monthly(t).filter("variable = 'A'"), False)])
