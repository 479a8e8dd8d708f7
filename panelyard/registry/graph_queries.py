"""Graph, similarity and top-k queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import graph as G
from ..operators import similarity as S
from ..operators.normalise import cross_z
from ..session import settle
from . import base as B
from .base import query

EDGES = "(SELECT src, dst, sum(weight) AS weight FROM {trade} WHERE src <> dst GROUP BY 1,2)"


def edges(t, trade=None):
    return (B.trade(t) if trade is None else trade).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def metric(t):
    return B.mret(t).select("date", "entity", F.col("ret").alias("value"))


@query("G1_neighbour_mean", f"""SELECT e.src AS entity, date, sum(weight*ret)/sum(weight) AS nbr FROM {EDGES} e JOIN {{mret}} m ON m.entity=e.dst GROUP BY 1,2""", "nbr")
def _(t):
    return G.neighbour_mean(metric(t), edges(t))


NORM = f"""e AS {EDGES}, w AS (SELECT src, dst, weight/sum(weight) OVER (PARTITION BY src) AS weight FROM e WHERE weight > 0)"""


@query("G3_two_hop_edges", f"""WITH {NORM} SELECT a.src, b.dst, sum(a.weight*b.weight) AS weight FROM w a JOIN w b ON a.dst=b.src WHERE a.src<>b.dst GROUP BY 1,2""", "weight")
def _(t):
    return G.two_hop_edges(edges(t))


@query("G3_two_hop_mean", f"""WITH {NORM}, h AS (SELECT a.src, b.dst, sum(a.weight*b.weight) AS weight FROM w a JOIN w b ON a.dst=b.src WHERE a.src<>b.dst GROUP BY 1,2)
   SELECT h.src AS entity, date, sum(weight*ret)/sum(weight) AS nbr FROM h JOIN {{mret}} m ON m.entity=h.dst GROUP BY 1,2""", "nbr")
def _(t):
    return G.two_hop_mean(metric(t), edges(t))


KATZ = f"""WITH {NORM}, k1 AS (SELECT src, dst, weight*0.5 AS weight FROM w), k2 AS (SELECT a.src, b.dst, sum(a.weight*b.weight) AS weight FROM k1 a JOIN k1 b ON a.dst=b.src GROUP BY 1,2),
   k3 AS (SELECT a.src, b.dst, sum(a.weight*b.weight) AS weight FROM k2 a JOIN k1 b ON a.dst=b.src GROUP BY 1,2),
   kz AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3) WHERE src<>dst GROUP BY 1,2)"""


@query("G4_katz_edges", f"{KATZ} SELECT * FROM kz", "weight")
def _(t):
    return G.katz_edges(edges(t))


@query("G4_katz_mean", f"{KATZ} SELECT kz.src AS entity, date, sum(weight*ret)/sum(weight) AS nbr FROM kz JOIN {{mret}} m ON m.entity=kz.dst GROUP BY 1,2", "nbr")
def _(t):
    return G.katz_mean(metric(t), edges(t))


def _pagerank_sql(rounds):
    out = [NORM, "n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM w UNION ALL SELECT dst FROM w))", "c AS (SELECT count(*) AS c FROM n)",
           "r0 AS (SELECT node, 1.0/c AS rank FROM n, c)"]
    for i in range(rounds):
        out.append(f"r{i+1} AS MATERIALIZED (SELECT n.node, 0.15/c + 0.85*(coalesce(s,0) + (SELECT coalesce(sum(rank),0) FROM r{i} WHERE node NOT IN (SELECT src FROM w))/c) AS rank "
                   f"FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(weight*rank) AS s FROM w JOIN r{i} ON r{i}.node=w.src GROUP BY 1) f ON f.dst=n.node)")
    return ", ".join(out)


@query("G5_pagerank", f"WITH {_pagerank_sql(30)} SELECT * FROM r30", "rank")
def _(t):
    return G.pagerank(edges(t), tolerance=1e-10)


@query("G5_hub_scaled_mean", f"""WITH {_pagerank_sql(30)}, h AS (SELECT src, dst, weight*rank AS weight FROM w JOIN r30 ON node=dst) SELECT src AS entity, date, sum(weight*ret)/sum(weight) AS nbr FROM h JOIN {{mret}} m ON m.entity=h.dst GROUP BY 1,2""", "nbr")
def _(t):
    e = edges(t)
    return G.neighbour_mean(metric(t), G.hub_scaled_edges(e, G.pagerank(e, tolerance=1e-10)))


@query("G6_bloc_mean")
def _(t):
    return G.bloc_mean(metric(t), G.blocs(edges(t), 4))


@query("G7_vintage_neighbour_mean", """WITH e AS (SELECT make_date(year+1,1,1) AS applies_from, src, dst, weight FROM {trade} WHERE src<>dst), v AS (SELECT applies_from, lead(applies_from) OVER (ORDER BY applies_from) AS nx FROM (SELECT DISTINCT applies_from FROM e))
   SELECT e.src AS entity, m.date, sum(weight*ret)/sum(weight) AS nbr FROM {mret} m JOIN v ON m.date >= v.applies_from AND (nx IS NULL OR m.date < nx) JOIN e ON e.applies_from=v.applies_from AND e.dst=m.entity GROUP BY 1,2""", "nbr")
def _(t):
    e = B.trade(t).select(F.make_date(F.col("year").cast("int") + 1, F.lit(1), F.lit(1)).alias("applies_from"), "src", "dst", "weight")
    return G.vintage_neighbour_mean(metric(t), e)


CAL = """tr AS (SELECT date, entity, CASE WHEN count(*) OVER f >= {n} THEN exp(sum(ln(1+ret)) OVER f)-1 END AS x FROM {{dret}} WINDOW f AS (PARTITION BY entity ORDER BY date ROWS {p} PRECEDING))"""
DAILY_FEATURES = f"""WITH {NORM}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM {{dret}})),
   l AS (SELECT date, entity, ret, exp(sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date)) AS lvl FROM dret),
   raw AS (SELECT date, entity, CASE WHEN count(*) OVER a = 21 THEN exp(sum(ln(1+ret)) OVER a)-1 END AS ret21, CASE WHEN count(*) OVER b = 63 THEN exp(sum(ln(1+ret)) OVER b)-1 END AS ret63, lvl/max(lvl) OVER (PARTITION BY entity ORDER BY date ROWS 251 PRECEDING)-1 AS dd FROM l
     WINDOW a AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING), b AS (PARTITION BY entity ORDER BY date ROWS 62 PRECEDING)),
   p AS (SELECT raw.*, i, lead(i) OVER (PARTITION BY entity ORDER BY i) AS nx FROM raw JOIN cal USING (date)),
   m AS MATERIALIZED (SELECT cal.date, entity, ret21, ret63, dd, (dd <= -0.10)::INT::DOUBLE AS deep FROM p JOIN cal ON cal.i BETWEEN p.i AND p.i+5 AND (nx IS NULL OR cal.i < nx)),
   h AS (SELECT a.src, b.dst, sum(a.weight*b.weight) AS weight FROM w a JOIN w b ON a.dst=b.src WHERE a.src<>b.dst GROUP BY 1,2),
   bank AS (SELECT src, dst, sum(ln(1+weight)) AS weight FROM {{trade}} WHERE src<>dst GROUP BY 1,2), hold AS (SELECT dst AS src, src AS dst, sum(weight) AS weight FROM trade WHERE src<>dst GROUP BY 1,2),
   g1 AS (SELECT src AS entity, m.date, sum(weight*ret21) FILTER (ret21 IS NOT NULL)/sum(weight) FILTER (ret21 IS NOT NULL) AS a, sum(weight*ret63) FILTER (ret63 IS NOT NULL)/sum(weight) FILTER (ret63 IS NOT NULL) AS b, sum(weight*deep)/sum(weight) AS d FROM e JOIN m ON m.entity=e.dst GROUP BY 1,2),
   g2 AS (SELECT src AS entity, m.date, sum(weight*ret21) FILTER (ret21 IS NOT NULL)/sum(weight) FILTER (ret21 IS NOT NULL) AS a, sum(weight*ret63) FILTER (ret63 IS NOT NULL)/sum(weight) FILTER (ret63 IS NOT NULL) AS b FROM bank JOIN m ON m.entity=bank.dst GROUP BY 1,2),
   g3 AS (SELECT src AS entity, m.date, sum(weight*dd)/sum(weight) AS a FROM hold JOIN m ON m.entity=hold.dst GROUP BY 1,2),
   g4 AS (SELECT src AS entity, m.date, sum(weight*ret21) FILTER (ret21 IS NOT NULL)/sum(weight) FILTER (ret21 IS NOT NULL) AS a FROM h JOIN m ON m.entity=h.dst GROUP BY 1,2),
   o AS (SELECT date, entity, a-ret21 AS value, 'TRADE_NBR_GAP_21' AS variable FROM g1 JOIN m USING (entity,date) UNION ALL SELECT date, entity, b-ret63, 'TRADE_NBR_GAP_63' FROM g1 JOIN m USING (entity,date)
     UNION ALL SELECT date, entity, a-ret21, 'BANK_NBR_GAP_21' FROM g2 JOIN m USING (entity,date) UNION ALL SELECT date, entity, b-ret63, 'BANK_NBR_GAP_63' FROM g2 JOIN m USING (entity,date)
     UNION ALL SELECT date, entity, a, 'HOLDER_STRESS' FROM g3 UNION ALL SELECT date, entity, a-ret21, 'TWOHOP_TRADE_GAP_21' FROM g4 JOIN m USING (entity,date) UNION ALL SELECT date, entity, d, 'NBR_DRAWDOWN_COUNT' FROM g1)
   SELECT variable, date_trunc('month', date)::DATE AS month, count(value) AS n, avg(value) AS mean_value FROM o WHERE value IS NOT NULL GROUP BY 1,2"""


@query("G2_network_features", DAILY_FEATURES, "mean_value")
def _(t):
    flows = settle(B.trade(t))  # three edge sets come from it
    bank = flows.groupBy("src", "dst").agg(F.sum(F.log1p("weight")).alias("weight"))
    holder = flows.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.sum("weight").alias("weight"))
    f = G.network_features(G.metrics_from_returns(B.dret(t)), edges(t, flows), bank, holder)
    return f.groupBy("variable", F.trunc("date", "month").alias("month")).agg(F.count("value").alias("n"), F.avg("value").alias("mean_value"))


LL = """d AS (SELECT date, entity, ret, dense_rank() OVER (ORDER BY date) AS t FROM {mret}), me AS (SELECT CAST(date_trunc('month',date) AS DATE) AS month, max(t) AS e FROM d GROUP BY 1 HAVING max(t) >= 24),
   ll AS (SELECT month, a.entity AS leader, b.entity AS follower, corr(a.ret, b.ret) AS corr, count(*) AS n FROM me JOIN d a ON a.t BETWEEN e-23 AND e-1 JOIN d b ON b.t=a.t+1 AND b.entity<>a.entity GROUP BY 1,2,3 HAVING count(*) >= 15 AND corr(a.ret,b.ret) >= 0.15),
   ok AS (SELECT month, entity, count(*) AS c FROM me JOIN d ON t BETWEEN e-23 AND e-1 GROUP BY 1,2 HAVING count(*) >= 15)"""


@query("G8_lead_lag_edges", f"WITH {LL} SELECT ll.month, leader, follower, corr FROM ll JOIN ok ON ok.month=ll.month AND ok.entity=ll.leader", "corr")
def _(t):
    return S.lead_lag_edges(B.mret(t), 24, 15)


@query("G9_leader_gap", f"""WITH {LL}, e AS (SELECT CAST(ll.month + INTERVAL 1 MONTH AS DATE) AS af, leader, follower, corr FROM ll JOIN ok ON ok.month=ll.month AND ok.entity=ll.leader), v AS (SELECT af, lead(af) OVER (ORDER BY af) AS nx FROM (SELECT DISTINCT af FROM e))
   SELECT m.date, follower AS entity, sum(corr*m.ret)/sum(corr) AS nbr, sum(corr*m.ret)/sum(corr) - any_value(o.ret) AS gap FROM mret m JOIN v ON m.date>=af AND (nx IS NULL OR m.date<nx) JOIN e ON e.af=v.af AND e.leader=m.entity JOIN mret o ON o.entity=follower AND o.date=m.date GROUP BY 1,2""", "nbr gap")
def _(t):
    e = S.lead_lag_edges(B.mret(t), 24, 15).select(F.add_months("month", 1).alias("applies_from"), F.col("follower").alias("src"), F.col("leader").alias("dst"), F.col("corr").alias("weight"))
    nbr = G.vintage_neighbour_mean(metric(t), e)
    return nbr.join(metric(t), ["entity", "date"]).select("date", "entity", "nbr", (F.col("nbr") - F.col("value")).alias("gap"))


STATE_V = """s AS (SELECT CAST(date_trunc('month',date) AS DATE) AS month, entity, variable, max_by(z, date) AS z FROM (SELECT date, entity, variable, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS z FROM {monthly} WINDOW g AS (PARTITION BY date, variable)) GROUP BY 1,2,3)"""


def z_state(t):
    return cross_z(B.monthly(t)).select(F.col("date").alias("month"), "entity", "variable", F.col("z").alias("value"))


@query("G10_fundamental_twins", f"""WITH {STATE_V}, c AS (SELECT month, entity, count(z) AS c, sqrt(sum(z*z)) AS n FROM s WHERE z IS NOT NULL GROUP BY 1,2), nv AS (SELECT month, count(DISTINCT variable) AS nv FROM s WHERE z IS NOT NULL GROUP BY 1),
   ok AS (SELECT c.* FROM c JOIN nv USING (month) WHERE c >= 0.6*nv QUALIFY count(*) OVER (PARTITION BY month) >= 10),
   p AS (SELECT a.month, a.entity AS focal, b.entity AS neighbor, sum(x.z*y.z)/(a.n*b.n) AS sim FROM ok a JOIN ok b ON a.month=b.month AND a.entity<>b.entity JOIN s x ON x.month=a.month AND x.entity=a.entity JOIN s y ON y.month=b.month AND y.entity=b.entity AND y.variable=x.variable GROUP BY a.month, a.entity, b.entity, a.n, b.n)
   SELECT month, focal, neighbor, sim, row_number() OVER (PARTITION BY month, focal ORDER BY sim DESC, neighbor) AS rank FROM p WHERE sim > 0 QUALIFY rank <= 5""", "sim")
def _(t):
    return S.fundamental_twins(z_state(t))


@query("G11_build_edges", """SELECT src, dst, weight, year AS snapshot, 'trade' AS edge_type FROM {trade} t WHERE src<>dst AND weight > 500000 AND year = (SELECT max(year) FROM trade u WHERE u.src=t.src)""", "weight", digits=4)
def _(t):
    return G.build_edges(B.trade(t).withColumnRenamed("year", "snapshot"), 500000, "trade")


@query("G12_month_edge_snapshot", """SELECT src, dst, weight, year::VARCHAR AS snapshot_month FROM {trade} WHERE year<>2000 UNION ALL SELECT src, dst, weight*2, '2000' FROM trade WHERE year=1999""", "weight", digits=4)
def _(t):
    tr = B.trade(t)
    stored = tr.select("src", "dst", "weight", F.col("year").cast("string").alias("snapshot_month"))
    return G.month_edge_snapshot(stored, tr.filter("year = 1999").select("src", "dst", (F.col("weight") * 2).alias("weight")), "2000")


@query("G13_state_embedding")
def _(t):
    d = X.month_end_levels(B.monthly(t), ["entity", "variable"]).withColumn("variable", F.concat_ws("_", "variable", F.date_format("month", "yyyyMM")))
    return S.state_embedding(d, 4)


DOT = "list_reduce(list_transform(range(1,65), lambda i: a.v[i]*b.v[i]), lambda x, y: x+y)"


@query("G14_nearest_entities", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 7)
   SELECT vec_id, list_dot_product(e.v, q.v)/(sqrt(list_dot_product(e.v,e.v))*sqrt(list_dot_product(q.v,q.v))) AS sim FROM e, q WHERE vec_id<>7 ORDER BY sim DESC, vec_id LIMIT 10""", "sim")
def _(t):
    return S.nearest_to(t.embeddings, "vec_id", "embedding", 7)


@query("G15_ranked_discoveries", """SELECT variable AS theme, entity, value AS score, row_number() OVER (PARTITION BY variable ORDER BY abs(value) DESC, entity) AS rank_in_theme, abs(value) AS abs_score
   FROM (SELECT variable, entity, arg_max(value,date) AS value FROM {user_daily} GROUP BY 1,2)""", "score abs_score")
def _(t):
    from ..operators.aggregates import state_vector
    s = state_vector(B.user_daily(t)).select(F.col("variable").alias("theme"), "entity", F.col("value").alias("score"))
    return G.ranked_discoveries(s)


@query("T2_best_per_group_queue", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r=1 ORDER BY value DESC, event_id LIMIT 40""", "value")
def _(t):
    return S.best_per_group(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id"], "value", ["event_id"], 40)


@query("T3_top_k_cosine", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v,v)) AS n FROM e)
   SELECT a.vec_id AS focal, b.vec_id AS neighbor, list_dot_product(a.v,b.v)/(a.n*b.n) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v,b.v)/(a.n*b.n) DESC, b.vec_id) AS rank
   FROM n a JOIN n b ON a.vec_id<>b.vec_id WHERE list_dot_product(a.v,b.v) > 0 QUALIFY rank <= 5""", "sim")
def _(t):
    return S.top_k_cosine(t.embeddings, "vec_id", "embedding", 5)


@query("T4_nearest_analogs", """WITH f AS (SELECT date::VARCHAR AS key, variable AS feature, sum(value) AS value FROM {monthly} GROUP BY 1,2), d AS (SELECT * FROM f WHERE key <= '2001-06-01'),
   r AS (SELECT key, feature, (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value)-1)/2.0)/count(*) OVER (PARTITION BY feature) AS p FROM d)
   SELECT r.key, sqrt(sum((r.p-t.p)**2)) AS distance FROM r JOIN r t ON t.key='2000-03-01' AND t.feature=r.feature WHERE r.key<>'2000-03-01' GROUP BY 1 ORDER BY distance, r.key LIMIT 10""", "distance")
def _(t):
    f = B.monthly(t).groupBy(F.col("date").cast("string").alias("key"), F.col("variable").alias("feature")).agg(F.sum("value").alias("value"))
    return S.nearest_analogs(f, "2000-03-01", 10, "2001-06-01")


@query("T5_diversified_selection", """WITH d AS (SELECT event_id, user_id%20 AS entity, event_type AS direction, (user_id%4)::BIGINT AS cls, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id%20, event_type ORDER BY value DESC, event_id)=1),
   c AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY value DESC, event_id) AS c FROM d) SELECT * EXCLUDE (c) FROM c ORDER BY c>1, value DESC, event_id LIMIT 12""", "value")
def _(t):
    d = t.events.select("event_id", (F.col("user_id") % 20).alias("entity"), F.col("event_type").alias("direction"), (F.col("user_id") % 4).alias("cls"), "value")
    return S.diversified(d, "cls", "value", "event_id", 12)


@query("T6_correlated_pairs", """SELECT a.entity AS a, b.entity AS b, corr(a.value,b.value) AS corr FROM {sales} a JOIN sales b ON a.date=b.date AND a.entity<b.entity GROUP BY 1,2 HAVING abs(corr(a.value,b.value)) >= 0.3""", "corr")
def _(t):
    return S.correlated_pairs(B.sales(t).drop("variable"), 0.3, "entity")


@query("T6_greedy_prune", """WITH RECURSIVE o AS (SELECT entity AS name, row_number() OVER (ORDER BY sum(value) DESC, entity) AS position FROM {sales} GROUP BY 1),
   c AS (SELECT a.entity AS a, b.entity AS b FROM sales a JOIN sales b ON a.date=b.date AND a.entity<>b.entity GROUP BY 1,2 HAVING abs(corr(a.value,b.value)) >= 0.2),
   k(position, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
     SELECT o.position, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.a=o.name AND list_contains(k.kept, c.b)) THEN k.kept ELSE list_append(k.kept, o.name) END FROM k JOIN o ON o.position=k.position+1)
   SELECT name, position FROM o WHERE list_contains((SELECT arg_max(kept, position) FROM k), name)""")
def _(t):
    s = B.sales(t)
    order = s.groupBy(F.col("entity").alias("name")).agg(F.sum("value").alias("v"))
    order = order.withColumn("position", F.row_number().over(Window.orderBy(F.col("v").desc(), "name")).cast("long"))
    return S.greedy_prune(order, S.correlated_pairs(s.drop("variable"), 0.2, "entity"))
