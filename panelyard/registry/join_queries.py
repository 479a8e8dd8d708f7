"""Sources, keys, point-in-time joins and grouped aggregates."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import keys as K
from ..sources import landing as L
from ..sources import ledgers as G
from ..sources import merge as M
from ..sources import schemas as S
from . import base as B
from .base import query


# The entity columns of the wide sheets.
NATIONS = [f"NATION_{i}" for i in range(25)]


def tidy(df, source):
    return df.withColumn("source", F.lit(source)).select("date", "entity", "value", "variable", "source")


@query("S1_panel_scan", """SELECT CAST(ts AS DATE) AS date, user_id::VARCHAR AS entity, value, event_type AS variable, 'events' AS source FROM events""", "value")
def _(t):
    raw = t.events.select(F.col("ts").alias("date"), F.col("user_id").alias("entity"), "value", F.col("event_type").alias("variable"), F.lit("events").alias("source"))
    return L.conform(raw, S.TIDY)


WIDE = """(SELECT date, sum(value) FILTER (variable='A') AS F_A_CS, sum(value) FILTER (variable='N') AS F_N_TS, sum(value) FILTER (variable='R') AS F_R FROM {monthly} GROUP BY 1)"""


def wide(t):
    v = F.col("variable")
    return B.monthly(t).groupBy("date").agg(
        *[F.sum(F.when(v == k, F.col("value"))).alias(n) for k, n in (("A", "F_A_CS"), ("N", "F_N_TS"), ("R", "F_R"))])


@query("S5_wide_melt", f"SELECT date, entity, value FROM {WIDE} UNPIVOT (value FOR entity IN (F_A_CS, F_N_TS, F_R))", "value", digits=4)
def _(t):
    return L.melt(wide(t), ["date"])


@query("S6_factor_returns_from_wide", f"SELECT date, factor, value, 'opt' AS source FROM {WIDE} UNPIVOT (value FOR factor IN (F_A_CS, F_N_TS))", "value", digits=4)
def _(t):
    return L.factor_returns_from_wide(wide(t), "opt")


@query("S7_membership_from_wide", """WITH w AS (SELECT date, n_name, value - avg(value) OVER (PARTITION BY date) AS weight FROM (SELECT date, entity AS n_name, value FROM {sales}))
   SELECT date, n_name AS entity, weight, 'SALES' AS factor, 'opt' AS source FROM w WHERE weight > 0""", "weight", digits=4)
def _(t):
    s = B.sales(t)
    d = s.join(s.groupBy("date").agg(F.avg("value").alias("_m")), "date").withColumn("x", F.col("value") - F.col("_m"))
    w = d.groupBy("date").agg(*[F.max(F.when(F.col("entity") == n, F.col("x"))).alias(n) for n in NATIONS])
    return L.membership_from_wide(w, "SALES", "opt")


@query("S8_replace_sources", """SELECT date, entity, value, variable, CASE variable WHEN 'A' THEN 'sa' WHEN 'N' THEN 'sn' ELSE 'sr' END AS source FROM {monthly} WHERE variable <> 'A'
   UNION ALL SELECT date, entity, value*2, variable, 'sa' FROM monthly WHERE variable='A'""", "value", digits=4)
def _(t):
    src = F.when(F.col("variable") == "A", "sa").when(F.col("variable") == "N", "sn").otherwise("sr")
    old = B.monthly(t).withColumn("source", src)
    fresh = old.filter("source = 'sa'").withColumn("value", F.col("value") * 2)
    return M.replace_sources(old, fresh, fresh)


@query("S9_upsert", """SELECT date, entity, variable, CASE WHEN year(date)>=2000 THEN -value ELSE value END AS value FROM {monthly}""", "value", digits=4)
def _(t):
    old = B.monthly(t)
    return M.upsert(old, old.filter(F.year("date") >= 2000).withColumn("value", -F.col("value")), ["date", "entity", "variable"])


@query("S9_upsert_latest_batch", """SELECT user_id, event_type, max_by(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1,2""", "value")
def _(t):
    return M.upsert_batches(t.events.select("user_id", "event_type", "value", "ts"), ["user_id", "event_type"], "ts")


@query("S10_replace_dates", """SELECT date, entity, variable, value FROM {monthly} WHERE date NOT IN (SELECT date FROM monthly WHERE month(date)=6)
   UNION ALL SELECT date, entity, variable, value+1 FROM monthly WHERE month(date)=6 AND variable='A'""", "value", digits=4)
def _(t):
    m = B.monthly(t)
    fresh = m.filter((F.month("date") == 6) & (F.col("variable") == "A")).withColumn("value", F.col("value") + 1)
    return M.replace_dates(m, fresh)


@query("S11_append_unseen", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus<>'F'""", "o_totalprice")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = o.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    return M.append_unseen(old, o.withColumn("o_totalprice", -F.col("o_totalprice")).drop("o_orderstatus"), ["o_orderkey"])


@query("S13_nested_series", """SELECT date, entity, variable, strftime(date, '%Y-%m') AS period, value FROM {monthly}""", "value", digits=4)
def _(t):
    m = B.monthly(t)
    obs = m.groupBy("entity", "variable").agg(
        F.map_from_entries(F.collect_list(F.struct(F.date_format("date", "yyyy-MM"), F.format_string("%.4f", F.col("value"))))).alias("o"))
    doc = obs.groupBy("variable").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(".", "entity", "variable"), F.struct("entity", F.col("variable").alias("indicator"), F.col("o").alias("observations"))))).alias("series"))
    return L.nested_series(doc.select(F.to_json(F.struct("series")).alias("payload")))


@query("S14_period_dates", """SELECT period, make_date(y, m, 1) AS date FROM (SELECT DISTINCT year(o_orderdate)::VARCHAR||'-Q'||quarter(o_orderdate)::VARCHAR AS period, year(o_orderdate) AS y, quarter(o_orderdate)*3 AS m FROM orders
   UNION ALL SELECT DISTINCT strftime(o_orderdate,'%Y-%m'), year(o_orderdate), month(o_orderdate) FROM orders UNION ALL SELECT DISTINCT strftime(o_orderdate,'%Y-M%m'), year(o_orderdate), month(o_orderdate) FROM orders
   UNION ALL SELECT DISTINCT year(o_orderdate)::VARCHAR, year(o_orderdate), 12 FROM orders)""")
def _(t):
    d = F.col("o_orderdate")
    y = F.year(d).cast("string")
    forms = F.array(F.concat_ws("-Q", y, F.quarter(d).cast("string")), F.date_format(d, "yyyy-MM"), F.concat(y, F.lit("-M"), F.date_format(d, "MM")), y)
    p = t.orders.select(F.explode(forms).alias("period")).distinct()
    return p.withColumn("date", L.period_to_date(F.col("period")))


@query("S15_numeric_text", """SELECT s_suppkey, CASE WHEN s_suppkey%7=0 THEN NULL WHEN s_suppkey%3=0 THEN -abs(s_acctbal) ELSE s_acctbal END AS value FROM supplier""", "value")
def _(t):
    b = F.format_string("%.2f", F.abs("s_acctbal"))
    text = (F.when(F.col("s_suppkey") % 7 == 0, "#N/A").when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("("), b, F.lit(")")))
            .otherwise(F.concat(F.format_number("s_acctbal", 2), F.lit("%"))))
    return t.supplier.select("s_suppkey", L.number(text).alias("value"))


# The grades of each score, written out for the SQL side.
GRADES = (
    ("AAA Aaa", 21), ("AA+ Aa1", 20), ("AA Aa2", 19), ("AA- Aa3", 18), ("A+ A1", 17), ("A A2", 16), ("A- A3", 15), ("BBB+ Baa1", 14), ("BBB Baa2", 13), ("BBB- Baa3", 12),
    ("BB+ Ba1", 11), ("BB Ba2", 10), ("BB- Ba3", 9), ("B+ B1", 8), ("B B2", 7), ("B- B3", 6), ("CCC+ Caa1", 5), ("CCC Caa2", 4), ("CCC- Caa3", 3), ("CC Ca", 2), ("C", 1),
    ("D SD RD", 0), ("NR WD N.A.", None),
)
GRADE_LIST = [(g, v) for names, v in GRADES for g in names.split()]


@query("S16_rating_score", f"""WITH g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {'NULL' if v is None else v})" for i, (_, v) in enumerate(GRADE_LIST))}) g(i, score))
   SELECT c_custkey, score::DOUBLE AS score FROM customer LEFT JOIN g ON c_custkey % {len(GRADE_LIST)} = i""", "score")
def _(t):
    names = F.array(*[F.lit(g) for g, _ in GRADE_LIST])
    grade = F.get(names, (F.col("c_custkey") % len(GRADE_LIST)).cast("int"))
    s = F.col("c_mktsegment")
    raw = F.when(s == "AUTOMOBILE", F.concat(grade, F.lit(" *-"))).when(s == "BUILDING", F.concat(grade, F.lit("u"))).when(s == "FURNITURE", F.concat(F.lit("(P)"), grade)).when(s == "HOUSEHOLD", F.concat(F.lit(" "), grade)).otherwise(grade)
    return t.customer.select("c_custkey", L.rating_score(raw).alias("score"))


@query("S17_ledger_fold", """SELECT conv_id, count(*) AS n_events, arg_max(text, turn) AS text, arg_max(role, turn) AS role FROM conversations
   WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY 1""")
def _(t):
    ev = t.conversations.withColumn("event", F.when(F.col("turn") == 0, "open").otherwise("update"))
    return G.fold(G.check_events(ev, ["open", "update"]), "conv_id", "open", ["text", "role"], {"update": ["text", "role"]}, order="turn")


LEDGER = """e AS (SELECT conv_id, turn, role, text, CASE WHEN turn=0 THEN 'open' WHEN turn%3=0 THEN 'status' WHEN turn%3=1 THEN 'verdict' ELSE 'mark' END AS event, CASE (length(text)+turn)%4 WHEN 0 THEN 'retired' WHEN 1 THEN 'rejected' WHEN 2 THEN 'void' ELSE 'hit' END AS status FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn=0))"""


def ledger(t):
    turn = F.col("turn")
    ev = t.conversations.select(
        "conv_id", "turn", F.when(turn == 0, "open").when(turn % 3 == 0, "status").when(turn % 3 == 1, "verdict").otherwise("mark").alias("event"),
        F.element_at(F.array(*[F.lit(x) for x in ("retired", "rejected", "void", "hit")]), ((F.length("text") + turn) % 4 + 1).cast("int")).alias("status"),
        F.substring("text", 1, 20).alias("verdict"), F.when(F.length("text") % 2 == 0, F.col("role")).alias("model_id"), F.length("text").cast("long").alias("cum_return"))
    return G.fold(G.check_events(ev, ["open", "status", "verdict", "mark"]), "conv_id", "open", ["model_id"], {"status": ["status"], "verdict": ["verdict"]}, order="turn", lists={"marks": ("mark", ["cum_return"])})


@query("Q14_effective_hypotheses", f"""WITH {LEDGER} SELECT conv_id, coalesce(max(CASE WHEN event='open' AND length(text)%2=0 THEN role END), 'unknown') AS model_id, arg_max(status, turn) FILTER (event='status') AS status, arg_max(substr(text,1,20), turn) FILTER (event='verdict') AS verdict,
   CASE WHEN coalesce(arg_max(status, turn) FILTER (event='status'), '') NOT IN ('retired','rejected') THEN arg_max(substr(text,1,20), turn) FILTER (event='verdict') END AS effective_verdict FROM e GROUP BY 1""")
def _(t):
    return G.effective_view(ledger(t), defaults={"model_id": "unknown"}).select("conv_id", "model_id", "status", "verdict", "effective_verdict")


@query("Q14_thesis_marks", f"""WITH {LEDGER}, m AS (SELECT conv_id, turn, length(text)::BIGINT AS cum_return, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS position FROM e WHERE event='mark'), s AS (SELECT conv_id, arg_max(status, turn) FILTER (event='status') AS st FROM e GROUP BY 1)
   SELECT m.*, CASE WHEN st='void' THEN 'void' ELSE st END AS outcome_label FROM m JOIN s USING (conv_id)""")
def _(t):
    f = ledger(t)
    return G.ledger_marks(f, "conv_id").withColumn("position", F.col("position").cast("long")).join(f.select("conv_id", G.outcome_label(F.col("status")).alias("outcome_label")), "conv_id")


@query("S18_vintage_manifest")
def _(t):
    return M.vintage_manifest(B.monthly(t), "2001-11")


GATE_BOUNDS = {"A": (0.0, 1e9), "N": (0.0, 1e9), "R": (0.0, 2e6)}


@query("S19_range_gate", """SELECT variable, entity, count(*) AS n, count(*) FILTER (value<=0 OR value > CASE variable WHEN 'R' THEN 2e6 ELSE 1e9 END) AS n_bad, 0::BIGINT AS n_unbounded,
   count(*) FILTER (value<=0 OR value > CASE variable WHEN 'R' THEN 2e6 ELSE 1e9 END) > 0.05*count(*) AS refuse FROM {monthly} GROUP BY 1,2""")
def _(t):
    return L.range_gate(B.monthly(t), GATE_BOUNDS)[1]


@query("S20_sentinel_table", f"SELECT date, variable, value FROM (SELECT date, CASE WHEN month(date)=1 THEN NULL ELSE F_A_CS END AS F_A_CS, F_N_TS, F_R FROM {WIDE}) UNPIVOT (value FOR variable IN (F_A_CS, F_N_TS, F_R))", "value", digits=4)
def _(t):
    w = wide(t).withColumn("F_A_CS", F.when(F.month("date") == 1, -99.99).otherwise(F.col("F_A_CS")))
    return L.read_sentinel_table(w, ["date"])


@query("S21_retention", """SELECT event_id, CAST(ts AS DATE) AS pull_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 14""")
def _(t):
    return M.drop_older_than(t.events.select("event_id", F.to_date("ts").alias("pull_date")), "2024-01-30", 14)


@query("S23_workbook_tables", """SELECT date, entity AS series_code, value, n_regionkey::BIGINT AS unit, CASE WHEN entity LIKE 'NATION_1%' THEN 'one' WHEN entity LIKE 'NATION_2%' THEN 'two' ELSE 'other' END AS category
   FROM {sales} JOIN nation ON n_name=entity""", "value", digits=4)
def _(t):
    w = B.sales(t).groupBy("date").agg(*[F.max(F.when(F.col("entity") == n, F.col("value"))).alias(n) for n in NATIONS])
    meta = t.nation.select(F.col("n_name").alias("series_code"), F.col("n_regionkey").cast("long").alias("unit"))
    return L.workbook_tables(w, meta, {"one": ["NATION_1"], "two": ["NATION_2"]})


@query("S24_annual_history", """SELECT year(date) AS year, entity AS iso3, CASE entity WHEN 'NATION_0' THEN 'Zero' ELSE entity END AS entity, 'sales' AS variable, sum(value) AS value, make_date(year(date),12,31) AS date FROM {sales} GROUP BY 1,2,3,6""", "value", digits=4)
def _(t):
    a = B.sales(t).groupBy(F.year("date").cast("long").alias("year"), "entity", F.col("entity").alias("iso3")).agg(F.sum("value").alias("sales"))
    return L.annual_history(a, rename={"NATION_0": "Zero"})


@query("S25_provider_extract", """SELECT CAST(o_orderdate AS DATE) AS date, o_custkey::VARCHAR AS entity, 'PRICE_OPEN' AS variable, o_totalprice AS value FROM orders WHERE o_orderpriority='1-URGENT' AND o_orderstatus='O'""", "value")
def _(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("unit"),
                        F.col("o_orderstatus").alias("measure"), F.format_number("o_totalprice", 2).alias("text"))
    return L.provider_extract(d, {"O": "PRICE_OPEN"}, "1-URGENT")


@query("S26_flow_subtotals", """SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS date, CASE WHEN o_orderstatus='F' THEN 'Equity' WHEN o_orderstatus='O' THEN 'Debt' ELSE 'Hybrid' END AS category,
   CASE WHEN o_orderstatus='F' THEN 'equity' WHEN o_orderstatus='O' THEN 'debt' ELSE 'other' END AS route, -sum(o_totalprice) AS net FROM orders GROUP BY 1,2,3""", "net", digits=2)
def _(t):
    # one report per order: a header line, then its sub-total line in parentheses
    o = t.orders
    cat = F.when(F.col("o_orderstatus") == "F", "Equity").when(F.col("o_orderstatus") == "O", "Debt").otherwise("Hybrid")
    head = o.select(F.col("o_orderkey").alias("report"), F.lit(1).alias("line"), F.to_date("o_orderdate").alias("date"), cat.alias("category"), F.lit("Stock").alias("label"), F.lit("0").alias("net"))
    sub = o.select(F.col("o_orderkey").alias("report"), F.lit(2).alias("line"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("category"),
                   F.lit("Sub-total").alias("label"), F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")")).alias("net"))
    return L.flow_subtotals(head.unionByName(sub))


@query("P1_unified_view", """SELECT date, entity, value, variable, 'ship' AS source FROM {monthly} UNION ALL SELECT date, entity, value, variable, 'sales' FROM {sales} UNION ALL SELECT date, entity, value, variable, 'day' FROM {daily}""", "value", digits=4)
def _(t):
    return K.unified([("ship", B.monthly(t)), ("sales", B.sales(t)), (None, tidy(B.daily(t), "day"))])


@query("P2_numeric_only", """SELECT doc_id, TRY_CAST(right(source, length(source)-3) AS DOUBLE) AS value FROM documents WHERE TRY_CAST(right(source, length(source)-3) AS DOUBLE) IS NOT NULL""", "value")
def _(t):
    return K.numeric_only(t.documents.select("doc_id", F.expr("substring(source, 4)").alias("value")))


@query("P3_universe_semi_join", """SELECT date, entity, variable, value FROM {monthly} WHERE entity IN (SELECT n_name FROM nation WHERE n_regionkey = 2)""", "value", digits=4)
def _(t):
    return K.in_universe(B.monthly(t), t.nation.filter("n_regionkey = 2").select(F.col("n_name").alias("entity")))


@query("P4_derived_names", """SELECT DISTINCT 'G_' || upper(p_brand) || '_' || upper(p_type) AS variable FROM part""")
def _(t):
    return t.part.select(K.derived_series_name("G_", F.col("p_brand"), F.col("p_type")).alias("variable")).distinct()


NAMES = "(SELECT DISTINCT entity || suffix AS variable FROM {sales}, (VALUES ('_CS'),('_TS'),('')) s(suffix))"


def names(t):
    return B.sales(t).select("entity").distinct().select(F.explode(F.array(*[F.concat("entity", F.lit(s)) for s in ("_CS", "_TS", "")])).alias("variable"))


@query("P5_P6_parse_names", f"""SELECT variable, regexp_replace(variable, '_(CS|TS)$', '') AS base_variable, CASE WHEN suffix(variable,'_CS') THEN 'cs' WHEN suffix(variable,'_TS') THEN 'ts' ELSE 'raw' END AS normalization FROM {NAMES}""")
def _(t):
    return K.parse_names(names(t))


FAMILIES = {"NATION_": "nation", "NATION_1": "one", "NATION_12": "twelve"}


@query("P7_longest_prefix", f"""SELECT variable, CASE WHEN variable LIKE 'NATION\\_12%' ESCAPE '\\' THEN 'twelve' WHEN variable LIKE 'NATION\\_1%' ESCAPE '\\' THEN 'one' ELSE 'nation' END AS family FROM {NAMES}""")
def _(t):
    return K.longest_prefix(names(t), FAMILIES)


@query("P8_keyword_category", """SELECT p_partkey, CASE WHEN regexp_matches(p_name,'(ring|bolt)') THEN 'hardware' WHEN regexp_matches(p_name,'^small') THEN 'small' ELSE 'other' END AS category FROM part""")
def _(t):
    return t.part.select("p_partkey", K.keyword_category(F.col("p_name"), [("(ring|bolt)", "hardware"), ("^small", "small")]).alias("category"))


@query("P9_canonical_names", """WITH m AS (SELECT n_regionkey AS code, n_name AS name, CASE n_nationkey%3 WHEN 0 THEN 'market_sleeve' WHEN 1 THEN 'sovereign' ELSE 'sovereign_proxy' END AS role, CASE n_nationkey%3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS p FROM nation)
  SELECT code, arg_min(name, (p, name)) AS entity, arg_min(role, (p, name)) AS role, string_agg(name, ',' ORDER BY p, name) AS variants, count(DISTINCT name) AS variant_count, string_agg(name, ',' ORDER BY name) FILTER (role='market_sleeve') AS market_sleeves FROM m GROUP BY 1""")
def _(t):
    k = F.col("n_nationkey") % 3
    m = t.nation.select(F.col("n_regionkey").alias("code"), F.col("n_name").alias("name"), F.when(k == 0, "market_sleeve").when(k == 1, "sovereign").otherwise("sovereign_proxy").alias("role"))
    c = K.canonical_names(m)
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    return c.withColumns({"variants": joined("variants"), "market_sleeves": joined("market_sleeves")})


@query("P10_code_fan_out", """SELECT o_orderkey, o_totalprice, n_name AS entity FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON n_regionkey = c_nationkey % 5""", "o_totalprice")
def _(t):
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", (F.col("c_nationkey") % 5).alias("code"))
    return K.fan_out(facts, t.nation.select(F.col("n_regionkey").alias("code"), F.col("n_name").alias("entity"))).drop("code")


@query("P11_remap_labels", """SELECT date, variable, value, CASE entity WHEN 'NATION_0' THEN 'ZERO' WHEN 'NATION_1' THEN 'ONE' ELSE entity END AS entity FROM {monthly}""", "value", digits=4)
def _(t):
    return K.remap(B.monthly(t), {"NATION_0": "ZERO", "NATION_1": "ONE"})


@query("P12_date_floor", """SELECT * FROM {monthly} WHERE date >= DATE '1998-01-01'""", "value", digits=4)
def _(t):
    return B.monthly(t).filter(F.col("date") >= F.lit("1998-01-01").cast("date"))


@query("P13_month_align", """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE)=last_day(o_orderdate) THEN CAST(date_trunc('month',o_orderdate) + INTERVAL 1 MONTH AS DATE) ELSE CAST(date_trunc('month',o_orderdate) AS DATE) END AS month FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", K.month_align(F.to_date("o_orderdate")).alias("month"))


@query("P14_complete_months", """SELECT date, entity, value, variable, CAST(date_trunc('month',date) AS DATE) AS month FROM {daily} WHERE date < DATE '2001-10-01'
   QUALIFY row_number() OVER (PARTITION BY entity, date_trunc('month',date) ORDER BY date DESC) = 1""", "value", digits=4)
def _(t):
    return K.complete_months(B.daily(t), ["entity"], "2001-10-17")


@query("P15_outcome_blind_payload", """SELECT event_id, '{"z":' || event_id::VARCHAR || '}' AS payload FROM events""")
def _(t):
    p = F.format_string('{"fwd_ret": {"m1": 0.1, "m3": [1,2]}, "z":%d, "outcome":"x,y"}', F.col("event_id"))
    d = t.events.select("event_id", K.strip_payload_keys(p, "fwd_ret|outcome").alias("payload"))
    return K.allow_listed(d, ["event_id", "payload"], "events", {"events": ["event_id", "payload"]})


@query("P16_look_ahead_guard", """SELECT DISTINCT variable FROM (SELECT 'MOM_' || variable AS variable FROM {monthly})""")
def _(t):
    v = B.monthly(t).select(F.explode(F.array(F.concat(F.lit("MOM_"), F.col("variable")), F.lit("12MRet"), F.lit(" 5DRet"))).alias("variable"))
    K.refuse_forward_returns("MOM_A")
    return K.without_forward_returns(v).distinct()


@query("P17_source_exclusion", """SELECT date, entity, value, variable, 'day' AS source FROM {daily}""", "value", digits=4)
def _(t):
    return K.without_sources(K.unified([("optimizer", B.monthly(t)), ("day", B.daily(t))]), ["optimizer"])


@query("P18_parse_question", """SELECT p_partkey, 'touch_low' AS question_class, 'down' AS direction, 'ABC' AS ticker, p_retailprice AS target, 1 - p_size/100.0 AS aligned_price FROM part WHERE p_size % 3 = 0
   UNION ALL SELECT p_partkey, 'close_above', 'up', 'XYZ', p_retailprice, p_size/100.0 FROM part WHERE p_size % 3 = 1""", "target aligned_price")
def _(t):
    amount = F.format_number("p_retailprice", 2)
    q = (F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Will Alphabet Corp (ABC) dip to $"), amount, F.lit(" this week?")))
         .when(F.col("p_size") % 3 == 1, F.concat(F.lit("Will Xylo (XYZ) close above $"), amount, F.lit("?"))).otherwise("Will it rain?"))
    d = t.part.select("p_partkey", q.alias("question"), (F.col("p_size") / 100).alias("probability"))
    return K.parse_question(d).drop("question", "probability")


@query("P19_keep_listed_columns", """SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, o_totalprice AS price, o_custkey::DOUBLE AS cust FROM orders) UNPIVOT (value FOR variable IN (price, cust))""", "value")
def _(t):
    return K.keep_listed_columns(t.orders, {"o_totalprice": "price", "o_custkey": "cust", "absent": "x"}, ["o_orderkey"])


@query("P20_candidate_slots", """SELECT * FROM (VALUES ('growth','A',2),('stress','R',1)) v(slot, variable, priority)""")
def _(t):
    return K.candidate_slots(B.monthly(t), [("growth", "GDP", 1), ("growth", "A", 2), ("growth", "N", 3), ("stress", "R", 1)])


@query("P21_sign_metadata", f"""SELECT variable, regexp_replace(variable, '_(CS|TS)$', '') AS base_variable, CASE WHEN suffix(variable,'_CS') THEN 'cs' WHEN suffix(variable,'_TS') THEN 'ts' ELSE 'raw' END AS normalization,
   'day' AS source, CASE WHEN regexp_replace(variable, '_(CS|TS)$', '') = 'NATION_3' THEN -1 ELSE 1 END AS sign, 'daily' AS frequency FROM {NAMES}""")
def _(t):
    return K.sign_metadata(K.parse_names(names(t)).withColumn("source", F.lit("day")), ["NATION_3"], {"day": "daily"})


@query("P22_listable_flag", """SELECT doc_id, NOT regexp_matches(text, '(?i)\\b(war|strike|invade|invasion|terror\\w*|assassinat\\w*|military)\\b') AS listable FROM documents""")
def _(t):
    return t.documents.select("doc_id", K.listable(F.col("text")).alias("listable"))


@query("J2_broadcast_globals", """WITH g AS (SELECT date, variable, max(value) AS value FROM {monthly} WHERE variable='A' AND entity<>'NATION_3' GROUP BY 1,2)
   SELECT g.date, n_name AS entity, g.value, g.variable, 'x' AS source FROM g, nation WHERE NOT EXISTS (SELECT 1 FROM monthly e WHERE e.entity=n_name AND e.date=g.date AND e.variable=g.variable AND e.entity<>'NATION_3')""", "value", digits=4)
def _(t):
    p = tidy(B.monthly(t).filter("entity <> 'NATION_3'"), "x")  # one entity lacks the variable
    return J.broadcast_globals(p, ["A"], t.nation.select(F.col("n_name").alias("entity")))


@query("J3_calendar_spine", """SELECT d.date, e.entity, t.date IS NOT NULL AS is_trading_day FROM (SELECT DISTINCT date FROM {daily}) d CROSS JOIN (SELECT DISTINCT entity FROM daily) e
   LEFT JOIN daily t ON t.date=d.date AND t.entity=e.entity""")
def _(t):
    d = B.daily(t)
    return J.calendar_spine(d, d)


@query("J4_asof_backward", """SELECT o_orderkey, x.asof_date, v FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, n_name AS entity FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey) o
   ASOF LEFT JOIN (SELECT date AS asof_date, entity, value AS v FROM {daily}) x ON o.entity = x.entity AND o.d >= x.asof_date""", "v", digits=4)
def _(t):
    who = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"))
    o = t.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.to_date("o_orderdate").alias("date"), "entity")
    return J.asof(o, B.daily(t).withColumnRenamed("value", "v"), ["entity"], ["v"]).select("o_orderkey", "asof_date", "v")


@query("J5_latest_as_of", """SELECT entity, arg_max(value, date) AS value, max(date) AS date, 'REV' AS variable FROM {daily} WHERE date <= DATE '1999-06-30' GROUP BY 1""", "value", digits=4)
def _(t):
    return J.latest_as_of(B.daily(t), "1999-06-30", ["entity"])


VINTAGES = "(SELECT DISTINCT entity, date AS applies_from, round(value/1e6,3) AS scale FROM {monthly} WHERE variable='A' AND month(date) IN (1,7))"


def scale_vintages(t):
    return B.monthly(t).filter((F.col("variable") == "A") & F.month("date").isin(1, 7)).select("entity", F.col("date").alias("applies_from"), F.round(F.col("value") / 1e6, 3).alias("scale"))


@query("J6_interval_months", f"""WITH v AS (SELECT *, lead(applies_from) OVER (PARTITION BY entity ORDER BY applies_from) AS applies_to FROM {VINTAGES})
   SELECT d.date, d.entity, d.value*scale AS scaled, applies_from FROM {{daily}} d JOIN v ON d.entity=v.entity AND d.date >= applies_from AND (applies_to IS NULL OR d.date < applies_to)""", "scaled", digits=7)
def _(t):
    j = J.interval_months(B.daily(t), scale_vintages(t), ["entity"])
    return j.select("date", "entity", (F.col("value") * F.col("scale")).alias("scaled"), "applies_from")


@query("J6_validity_intervals", f"""SELECT *, lead(applies_from) OVER (PARTITION BY entity ORDER BY applies_from) AS applies_to FROM {VINTAGES}""", "scale")
def _(t):
    return J.validity_intervals(scale_vintages(t), ["entity"])


@query("J7_month_offset_join", """WITH c AS (SELECT entity, year(date)*12+month(date) AS m, sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date) AS cum FROM {mret})
   SELECT s.date, s.entity, s.variable, s.value, exp(b.cum-a.cum)-1 AS fwd_return FROM {monthly} s JOIN c a ON a.entity=s.entity AND a.m=year(s.date)*12+month(s.date)+1 JOIN c b ON b.entity=s.entity AND b.m=a.m+3""", "value fwd_return", digits=4)
def _(t):
    return J.month_offset_returns(B.monthly(t), B.mret(t), 1, 3)


@query("J8_day_offset_join", """WITH c AS MATERIALIZED (SELECT entity, date, sum(ln(1+ret)) OVER (PARTITION BY entity ORDER BY date) AS cum FROM {dret}),
   l AS MATERIALIZED (SELECT entity, date, lead(cum, 1) OVER w AS x, lead(cum, 6) OVER w AS y FROM c WINDOW w AS (PARTITION BY entity ORDER BY date))
   SELECT d.date, d.entity, d.value, exp(y-x)-1 AS fwd_return FROM {daily} d JOIN l ON l.entity=d.entity AND l.date=d.date WHERE y IS NOT NULL""", "value fwd_return", digits=4)
def _(t):
    return J.day_offset_returns(B.daily(t).drop("variable"), B.dret(t), 1, 5)


@query("J9_same_year_annual", """SELECT m.date, m.entity, m.variable, m.value/gdp*100 AS pct FROM {monthly} m LEFT JOIN (SELECT entity, year(date) AS y, arg_max(value,date) AS gdp FROM {sales} GROUP BY 1,2) g
   ON g.entity=m.entity AND g.y=year(m.date)""", "pct")
def _(t):
    d = J.attach_same_year(B.monthly(t), B.sales(t), "gdp")
    return d.select("date", "entity", "variable", (F.col("value") / F.col("gdp") * 100).alias("pct"))


@query("J10_anti_join", """SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')""")
def _(t):
    seen = t.lineitem.filter((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R")).select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.select("s_suppkey").join(seen, "s_suppkey", "left_anti")


@query("J12_nearest", """WITH o AS (SELECT DISTINCT date, entity FROM {daily}), h AS (SELECT date AS hd, entity, ret FROM {dret} WHERE ret < -0.09),
   b AS (SELECT o.*, h.hd AS bt, h.ret AS bv FROM o ASOF LEFT JOIN h ON o.entity=h.entity AND o.date >= h.hd), f AS (SELECT b.*, h.hd AS ft, h.ret AS fv FROM b ASOF LEFT JOIN h ON b.entity=h.entity AND b.date <= h.hd)
   SELECT date, entity, CASE WHEN bt IS NULL OR ft-date < date-bt THEN fv ELSE bv END AS ret, CASE WHEN bt IS NULL OR ft-date < date-bt THEN ft ELSE bt END AS matched FROM f""", "ret")
def _(t):
    return J.nearest(B.daily(t).select("date", "entity"), B.dret(t).filter("ret < -0.09"), ["entity"], "ret")


def shocks(t):
    """Large user-day totals as dated events."""
    d = t.events.groupBy(F.to_date("ts").alias("event_date"), "user_id").agg(F.round(F.sum("value"), 2).alias("v"), F.count("*").alias("n"))
    return d.filter("n >= 3").select(
        F.concat_ws("-", "user_id", F.date_format("event_date", "yyyyMMdd")).alias("event_id"), "event_date",
        F.when(F.col("n") > 4, F.date_add("event_date", 3)).alias("end_date"),
        F.when(F.col("v") > 200, "policy").otherwise("shock").alias("category"), F.least(F.col("n"), F.lit(5)).cast("int").alias("severity"),
        F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string"), F.lit(", U"), (F.col("user_id") % 7).cast("string")).alias("countries_affected"),
        (F.col("user_id") % 11 == 0).alias("is_global"), F.when(F.col("user_id") % 2 == 0, "even,all").otherwise("odd,all").alias("tags"))


SHOCKS = """(SELECT user_id::VARCHAR||'-'||strftime(d,'%Y%m%d') AS event_id, d AS event_date, CASE WHEN n>4 THEN d+3 END AS end_date, CASE WHEN v>200 THEN 'policy' ELSE 'shock' END AS category, least(n,5)::INTEGER AS severity,
   'U'||(user_id%10)::VARCHAR||', U'||(user_id%7)::VARCHAR AS countries_affected, user_id%11=0 AS is_global, CASE WHEN user_id%2=0 THEN 'even,all' ELSE 'odd,all' END AS tags
   FROM (SELECT CAST(ts AS DATE) AS d, user_id, round(sum(value),2) AS v, count(*) AS n FROM events GROUP BY 1,2) WHERE n>=3)"""


@query("J13_event_overlap", f"""SELECT * FROM {SHOCKS} WHERE event_date <= DATE '2024-01-20' AND coalesce(end_date,event_date) >= DATE '2024-01-10' AND (is_global OR list_contains(string_split(countries_affected, ', '), 'U3'))""")
def _(t):
    return J.events_overlapping(shocks(t), "2024-01-10", "2024-01-20", entity="U3")


@query("J15_prefer_source", """SELECT coalesce(a.date,b.date) AS date, coalesce(a.entity,b.entity) AS entity, coalesce(a.value,b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'first' ELSE 'second' END AS origin
   FROM (SELECT * FROM {monthly} WHERE variable='A' AND year(date)<1999) a FULL JOIN (SELECT * FROM monthly WHERE variable='N') b ON a.date=b.date AND a.entity=b.entity""", "value", digits=4)
def _(t):
    m = B.monthly(t)
    return J.prefer(m.filter("variable = 'A' AND year(date) < 1999"), m.filter("variable = 'N'"), ["date", "entity"])


@query("J16_region_benchmark", """SELECT m.date, m.entity, m.ret - r.bench AS active FROM {mret} m JOIN nation ON n_name=m.entity JOIN (SELECT date, n_regionkey AS region, avg(ret) AS bench FROM mret JOIN nation ON n_name=entity GROUP BY 1,2) r
   ON r.region=n_regionkey AND r.date=m.date""", "active")
def _(t):
    reg = t.nation.select(F.col("n_name").alias("entity"), F.col("n_regionkey").alias("region"))
    bench = B.mret(t).join(reg, "entity").groupBy("date", "region").agg(F.avg("ret").alias("bench"))
    return J.apply_benchmark(B.mret(t), reg, bench).select("date", "entity", (F.col("ret") - F.col("bench")).alias("active"))


@query("J17_consistency", """WITH me AS (SELECT entity, CAST(date_trunc('month',date) AS DATE) AS date, arg_max(value,date) AS d FROM {daily} GROUP BY 1,2)
   SELECT 'A' AS variable, count(*) AS n, corr(d, m.value) AS correlation, avg(abs(d-m.value)) AS mean_abs_diff FROM me JOIN {monthly} m ON m.entity=me.entity AND m.date=me.date AND m.variable='A'""", "correlation mean_abs_diff", digits=4)
def _(t):
    return J.consistency(B.daily(t).withColumn("variable", F.lit("A")), B.monthly(t).filter("variable = 'A'"))


@query("J18_mirror_fill", """WITH e AS (SELECT src, dst, year, weight AS exports, floor(weight*0.5) AS imports, false AS mirrored FROM {trade} WHERE src NOT IN ('NATION_3','NATION_7')),
   u AS (SELECT * FROM e UNION ALL SELECT dst, src, year, imports, exports, true FROM e WHERE dst IN (SELECT dst FROM e EXCEPT SELECT src FROM e))
   SELECT *, exports+imports AS total, CASE WHEN sum(exports+imports) OVER w <> 0 THEN (exports+imports)/sum(exports+imports) OVER w*100 ELSE 0 END AS share_pct FROM u WINDOW w AS (PARTITION BY src, year)""", "exports imports total share_pct", digits=4)
def _(t):
    e = B.trade(t).filter(~F.col("src").isin("NATION_3", "NATION_7")).select("src", "dst", "year", F.col("weight").alias("exports"), F.floor(F.col("weight") * 0.5).cast("double").alias("imports"))
    return J.mirror_fill(e)


@query("A1_coverage", """SELECT variable, count(value) AS n_obs, count(DISTINCT entity) AS n_entities, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM {monthly} GROUP BY 1""")
def _(t):
    return A.coverage(B.monthly(t), ("variable",))


@query("A2_missingness", """SELECT variable, count(value) AS n_obs, count(DISTINCT entity) AS n_entities, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date,
   greatest(0, 1-count(value)/((year(max(date))*12+month(max(date))-year(min(date))*12-month(min(date))+1)*count(DISTINCT entity))) AS missingness, variable LIKE 'R%' AS is_forecast, NOT variable LIKE 'R%' AS vintage_safe FROM {monthly} GROUP BY 1""", "missingness")
def _(t):
    return A.missingness(A.coverage(B.monthly(t), ("variable",)), ["R"])


@query("A3_last_in_month", """SELECT entity, variable, CAST(date_trunc('month',date) AS DATE) AS month, arg_max(value,date) AS value FROM {daily} GROUP BY 1,2,3""", "value", digits=4)
def _(t):
    return A.last_in_month(B.daily(t))


@query("A5_month_snapshot", """SELECT date, entity, CAST(date_trunc('month',date) AS DATE) AS month, variable, value FROM {user_daily} QUALIFY date = max(date) OVER (PARTITION BY entity, date_trunc('month',date))""", "value")
def _(t):
    return J.month_snapshot(B.user_daily(t).drop("n"))


@query("A8_factor_statistics", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM {mret})
   SELECT entity, max(ret) FILTER (r=1) AS latest, max(date) FILTER (r=1) AS last_date, CASE WHEN count(ret) FILTER (r<=12) >= 12 THEN sum(ret) FILTER (r<=12) END AS sum_short, avg(ret) FILTER (r<=60) AS mean_long,
   stddev_samp(ret) FILTER (r<=60) AS std_long, count(ret) FILTER (r<=60) AS n_long, CASE WHEN count(ret) FILTER (r<=60)>=24 THEN avg(ret) FILTER (r<=60)*12/(stddev_samp(ret) FILTER (r<=60)*sqrt(12)) END AS sharpe FROM r GROUP BY 1""",
   "latest sum_short mean_long std_long sharpe")
def _(t):
    return A.factor_statistics(B.mret(t).withColumnRenamed("ret", "value"), ["entity"])


@query("A9_running_sum_range", """SELECT entity, max(c)-min(c) AS drawdown_range FROM (SELECT entity, sum(ret) OVER (PARTITION BY entity ORDER BY date) AS c FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM {dret}) WHERE r<=252) GROUP BY 1""", "drawdown_range")
def _(t):
    return A.running_sum_range(B.dret(t).withColumnRenamed("ret", "value"), 252, ["entity"])


@query("A10_mean_pair_correlation", """WITH d AS (SELECT date, entity, ret, dense_rank() OVER (ORDER BY date) AS t FROM {mret}),
   w AS (SELECT *, count(*) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM d),
   ok AS (SELECT entity, t AS e FROM w WHERE n = 12),
   c AS (SELECT a.e, corr(x.ret, y.ret) AS c FROM ok a JOIN ok b ON a.e=b.e AND a.entity < b.entity JOIN d x ON x.entity=a.entity AND x.t BETWEEN a.e-11 AND a.e JOIN d y ON y.entity=b.entity AND y.t=x.t GROUP BY a.e, a.entity, b.entity)
   SELECT k.date, nn.n_series, avg(c) AS mean_corr FROM c JOIN (SELECT e, count(*) AS n_series FROM ok GROUP BY 1) nn ON nn.e=c.e JOIN (SELECT DISTINCT date, t FROM d) k ON k.t = c.e+1 GROUP BY 1,2""", "mean_corr")
def _(t):
    return A.mean_pair_correlation(B.mret(t).withColumnRenamed("ret", "value"), 12, "entity")


@query("A11_dispersion", """SELECT date, variable, stddev_samp(value) AS dispersion, count(value) AS n FROM {monthly} GROUP BY 1,2""", "dispersion", digits=4)
def _(t):
    return A.dispersion(B.monthly(t))


@query("A12_benchmarks", """WITH w AS (SELECT date, entity, value/sum(value) OVER (PARTITION BY date) AS weight FROM {sales})
   SELECT m.date, avg(ret) AS equal_weight, sum(ret*weight) AS cap_weight, max(ret) FILTER (m.entity='NATION_5') AS single_market FROM {mret} m LEFT JOIN w ON w.date=m.date AND w.entity=m.entity GROUP BY 1""", "equal_weight cap_weight single_market")
def _(t):
    w = A.index_weights(B.sales(t)).select("date", "entity", (F.col("weight_pct") / 100).alias("weight"))
    return A.benchmarks(B.mret(t), w, "NATION_5")


@query("A13_portfolio_shares", """SELECT year AS date, src, dst, weight AS amount, weight/sum(weight) OVER (PARTITION BY year, src)*100 AS share_of_reporter,
   CASE WHEN count(*) OVER (PARTITION BY year, dst) > 1 THEN weight/sum(weight) OVER (PARTITION BY year, dst)*100 END AS share_of_inbound FROM {trade}""", "amount share_of_reporter share_of_inbound", digits=4)
def _(t):
    return A.portfolio_shares(B.trade(t).select(F.col("year").alias("date"), "src", "dst", F.col("weight").alias("amount")))


@query("A14_trade_category_shares", """WITH i AS (SELECT n_name AS entity, year(l_shipdate) AS year, p_type, sum(l_extendedprice) AS x, sum(l_quantity) AS m FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY 1,2,3),
   c AS (SELECT entity, year, CASE WHEN p_type IN ('SMALL','MEDIUM') THEN 'size' WHEN p_type='PROMO' THEN 'promo' END AS category, sum(x) AS x, sum(m) AS m FROM i GROUP BY 1,2,3),
   s AS (SELECT *, x/sum(x) OVER w AS ex, m/sum(m) OVER w AS im FROM c WINDOW w AS (PARTITION BY entity, year))
   SELECT entity, year, category, ex AS export_share, im AS import_share, ex-im AS net_share FROM s WHERE category IS NOT NULL""", "export_share import_share net_share")
def _(t):
    li = t.lineitem.groupBy("l_suppkey", "l_partkey", F.year("l_shipdate").cast("long").alias("year")).agg(F.sum("l_extendedprice").alias("exports"), F.sum("l_quantity").alias("imports"))
    d = li.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(B.supplier_nation(t), F.col("l_suppkey") == F.col("s_suppkey"))
    cat = F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "size").when(F.col("p_type") == "PROMO", "promo")
    return A.trade_category_shares(d, cat)


@query("A15_index_weights", """SELECT date, entity, weight_pct, weight_pct - lag(weight_pct) OVER (PARTITION BY entity ORDER BY date) AS weight_change FROM (SELECT *, value/sum(value) OVER (PARTITION BY date)*100 AS weight_pct FROM {sales})""", "weight_pct weight_change")
def _(t):
    return A.index_weights(B.sales(t)).drop("value", "variable")


@query("A16_percentile_composite", """WITH r AS (SELECT date, entity, (rank() OVER (PARTITION BY date, variable ORDER BY value) + (count(*) OVER (PARTITION BY date, variable, value)-1)/2.0)/count(*) OVER (PARTITION BY date, variable)*100 AS p FROM {monthly})
   SELECT date, entity, avg(p) AS value, count(p) AS components, 'DISTORTION' AS variable FROM r GROUP BY 1,2 HAVING count(p) >= 2""", "value")
def _(t):
    return A.percentile_composite(B.monthly(t), "DISTORTION")


@query("A25_demographic_index", """WITH p AS (SELECT c_mktsegment AS entity, year(o_orderdate) AS year, c_nationkey%5 AS cohort, sum(o_totalprice) AS population FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2,3),
   s AS (SELECT *, population/sum(population) OVER (PARTITION BY entity, year) AS s FROM p), m AS (SELECT *, avg(s) OVER (PARTITION BY year, cohort) AS m FROM s),
   d AS (SELECT entity, year, sum(s*(cohort-2)*0.1)*100 AS index_abs, sum((s-m)*(cohort-2)*0.1)*100 AS index_rel FROM m GROUP BY 1,2)
   SELECT *, index_rel - lag(index_rel,5) OVER (PARTITION BY entity ORDER BY year) AS chg_5, index_rel - lag(index_rel,10) OVER (PARTITION BY entity ORDER BY year) AS chg_10 FROM d""", "index_abs index_rel chg_5 chg_10")
def _(t):
    p = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("entity"), F.year("o_orderdate").cast("long").alias("year"), (F.col("c_nationkey") % 5).alias("cohort"), F.col("o_totalprice").alias("population"))
    return A.demographic_index(p, (F.col("cohort") - 2) * 0.1)


@query("A26_leaders_laggards", """WITH s AS (SELECT entity, sum(ret) AS total, count(ret) AS n_obs FROM {mret} WHERE date >= DATE '2000-01-01' GROUP BY 1)
   (SELECT *, 'leader' AS side FROM s ORDER BY total DESC NULLS LAST, entity LIMIT 5) UNION ALL (SELECT *, 'laggard' FROM s ORDER BY total NULLS LAST, entity LIMIT 5)""", "total")
def _(t):
    return A.leaders_laggards(B.mret(t).filter("date >= date'2000-01-01'"), 5, "entity", "ret")


@query("A27_cross_source_discrepancy", """WITH a AS (SELECT entity, CAST(date_trunc('month',date) AS DATE) AS month, arg_max(value,date) AS a FROM {daily} GROUP BY 1,2), j AS (SELECT a.*, m.value AS b FROM a JOIN {monthly} m ON m.entity=a.entity AND m.date=a.month AND m.variable='A')
   SELECT entity, quantile_cont(abs(a-b),0.5) AS median_abs_diff, count(*) AS n, quantile_cont(abs(a-b),0.5) > 100000 AS breach FROM j WHERE month > (SELECT max(month) FROM j) - INTERVAL 24 MONTH GROUP BY 1""", "median_abs_diff", digits=4)
def _(t):
    return A.cross_source_discrepancy(B.daily(t), B.monthly(t).filter("variable = 'A'"), 24, 100000.0)


@query("A28_sentinel_check", """WITH s AS (SELECT n_name AS entity, 'REV' AS variable, 50000.0 AS expected, 20000.0 AS tolerance FROM nation), l AS (SELECT entity, variable, arg_max(value,date) AS value, max(date) AS date FROM {daily} WHERE date BETWEEN DATE '2001-06-20' AND DATE '2001-06-30' GROUP BY 1,2)
   SELECT s.*, value, date, CASE WHEN value IS NULL THEN 'missing' WHEN abs(value-expected)>tolerance THEN 'breach' ELSE 'ok' END AS status FROM s LEFT JOIN l USING (entity, variable)""", "value expected tolerance", digits=4)
def _(t):
    s = t.nation.select(F.col("n_name").alias("entity"), F.lit("REV").alias("variable"), F.lit(50000.0).alias("expected"), F.lit(20000.0).alias("tolerance"))
    return A.sentinel_check(B.daily(t), s, "2001-06-30", 10)


@query("A29_state_vector", """SELECT entity, variable, arg_max(value,date) AS value, max(date) AS date FROM {user_daily} GROUP BY 1,2""", "value")
def _(t):
    return A.state_vector(B.user_daily(t))


@query("A30_entity_profile", """SELECT 'value' AS kind, variable AS name, NULL AS other, arg_max(value,date) AS value FROM {monthly} WHERE entity='NATION_4' GROUP BY 2 UNION ALL
   SELECT 'out', 'trade', dst, sum(weight) FROM {trade} WHERE src='NATION_4' GROUP BY dst UNION ALL SELECT 'in', 'trade', src, sum(weight) FROM trade WHERE dst='NATION_4' GROUP BY src""", "value", digits=4)
def _(t):
    e = B.trade(t).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("edge_type", F.lit("trade"))
    return A.entity_profile(A.state_vector(B.monthly(t)), e, "NATION_4")


@query("A34_holder_share", """WITH s AS (SELECT year AS date, dst AS code, coalesce(sum(weight) FILTER (src='NATION_6'),0)/sum(weight)*100 AS value FROM {trade} GROUP BY 1,2) SELECT s.*, n2.n_name AS entity FROM s JOIN nation n ON n.n_name=code JOIN nation n2 ON n2.n_regionkey=n.n_regionkey""", "value")
def _(t):
    h = B.trade(t).select(F.col("year").alias("date"), "src", "dst", F.col("weight").alias("amount"))
    n = t.nation
    fan = n.select(F.col("n_name").alias("code"), "n_regionkey").join(n.select(F.col("n_name").alias("entity"), "n_regionkey"), "n_regionkey").drop("n_regionkey")
    return A.holder_share(h, "NATION_6", fan)


@query("A35_extremes_board", """WITH z AS (SELECT date, entity, variable, (value-avg(value) OVER g)/stddev_pop(value) OVER g AS value FROM {monthly} WINDOW g AS (PARTITION BY date, variable)),
   l AS (SELECT entity, variable, arg_max(value,date) AS value, max(date) AS date FROM z WHERE date <= DATE '2001-06-30' GROUP BY 1,2),
   p AS (SELECT entity, max(date) AS date, max(value) FILTER (variable='A') AS "A", max(value) FILTER (variable='N') AS "N", max(value) FILTER (variable='R') AS "R" FROM l GROUP BY 1)
   SELECT *, greatest(abs(coalesce("A",0)),abs(coalesce("N",0))) AS max_abs_z, DATE '2001-06-30' - date > 20 AS stale FROM p WHERE greatest(abs(coalesce("A",0)),abs(coalesce("N",0))) >= 1""", "A N R max_abs_z")
def _(t):
    from ..operators.normalise import cross_z
    z = cross_z(B.monthly(t)).select("date", "entity", "variable", F.col("z").alias("value"))
    return A.extremes_board(z, ["A", "N", "R"], ["A", "N"], 1.0, "2001-06-30", 20)


@query("A36_forward_calendar", f"""SELECT c.category, count(e.event_id) AS n_ahead, min(e.event_date) AS next_date, count(e.event_id) < 2 AS warn FROM (VALUES ('policy'),('shock'),('election')) c(category) LEFT JOIN (SELECT * FROM {SHOCKS} WHERE event_date > DATE '2024-01-28') e ON e.category=c.category GROUP BY 1""")
def _(t):
    return A.forward_calendar(shocks(t), ["policy", "shock", "election"], "2024-01-28")


HYP = """(SELECT o_orderkey AS hid, o_orderpriority AS family, o_orderstatus AS fam2, CASE o_orderstatus WHEN 'F' THEN 'WATCH' WHEN 'O' THEN 'INSUFFICIENT_HISTORY' END AS verdict FROM orders)"""


def hypotheses(t):
    return t.orders.select(F.col("o_orderkey").alias("hid"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("fam2"),
                           F.when(F.col("o_orderstatus") == "F", "WATCH").when(F.col("o_orderstatus") == "O", "INSUFFICIENT_HISTORY").alias("verdict"))


@query("A37_trial_conservation", f"""WITH h AS (SELECT *, CASE WHEN verdict IS NULL THEN 0 WHEN verdict LIKE 'INSUFF%' THEN 0.5 ELSE 1.0 END AS c FROM {HYP}), a AS (SELECT family, sum(c) AS b FROM h GROUP BY 1), b AS (SELECT fam2 AS family, sum(c) AS a FROM h GROUP BY 1)
   SELECT coalesce(a.family,b.family) AS family, coalesce(b,0) AS before, coalesce(a,0) AS after, true AS conserved FROM a FULL JOIN b ON a.family=b.family""", "before after")
def _(t):
    return A.trial_conservation(hypotheses(t).withColumn("charge", G.trial_charge(F.col("verdict"))), "family", "fam2")


@query("H15_family_trials", f"""SELECT family, greatest(1, round_even(sum(CASE WHEN verdict IS NULL THEN 0 WHEN verdict LIKE 'INSUFF%' THEN 0.5 ELSE 1.0 END),0))::BIGINT AS n_trials, count(*) AS n_hypotheses FROM {HYP} GROUP BY 1""")
def _(t):
    return G.family_trials(hypotheses(t))


@query("A38_variable_catalogue", """SELECT variable, count(value) AS n_obs, count(DISTINCT entity) AS n_entities, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, DATE '2001-12-31'-max(date) AS days_stale FROM {monthly} GROUP BY 1""")
def _(t):
    return A.variable_catalogue(B.monthly(t), "2001-12-31")


@query("A38_panel_quality", """SELECT event_type AS variable, sum(c)::BIGINT AS n_rows, count(*) FILTER (c>1) AS n_duplicate_keys, sum(nul)::BIGINT AS n_null, sum(o)::BIGINT AS n_out_of_range FROM (SELECT CAST(ts AS DATE) AS d, user_id, event_type, count(*) AS c, count(*) FILTER (value IS NULL) AS nul, count(*) FILTER (value<1 OR value>100) AS o FROM events GROUP BY 1,2,3) GROUP BY 1""")
def _(t):
    d = t.events.select(F.to_date("ts").alias("date"), F.col("user_id").alias("entity"), F.col("event_type").alias("variable"), "value")
    return A.composition_check(d, 1, 100)


@query("U2_keep_last", """SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return M.keep_last(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("U3_missing_dates", """SELECT DISTINCT e.entity, d.date FROM (SELECT DISTINCT entity FROM {sales}) e CROSS JOIN (SELECT DISTINCT date FROM {monthly}) d WHERE NOT EXISTS (SELECT 1 FROM {mret} m WHERE m.entity=e.entity AND m.date=d.date)""")
def _(t):
    spine = J.calendar_spine(B.monthly(t), B.monthly(t)).select("entity", "date")
    return spine.join(B.mret(t).select("entity", "date"), ["entity", "date"], "left_anti")


@query("U4_common_calendar", """SELECT DISTINCT date, entity FROM {mret} INTERSECT SELECT date, entity FROM {monthly} WHERE variable='R'""")
def _(t):
    return B.mret(t).select("date", "entity").join(B.monthly(t).filter("variable = 'R'").select("date", "entity"), ["date", "entity"])


@query("T1_global_top_n", """SELECT date, entity, ret FROM {mret} ORDER BY ret DESC NULLS LAST, entity, date LIMIT 25""", "ret")
def _(t):
    return B.mret(t).orderBy(F.col("ret").desc_nulls_last(), "entity", "date").limit(25)
