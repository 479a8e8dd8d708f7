"""News, prediction-market, forecast-scoring and strategy queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import features as X
from ..operators import joins as J
from ..operators import markets as M
from ..operators import news as W
from ..operators import normalise as N
from ..operators import portfolio as P
from ..plans import studies as R
from ..session import settle
from . import base as B
from .base import query
from .harness_queries import IC, SIG, signals
from .study_queries import RG, macro


def documents(t):
    """Documents with a tone record, a location list and themes derived from their text: its
    length and the number of its e's."""
    n = F.length("text") + 7 * (F.length("text") - F.length(F.replace(F.col("text"), F.lit("e"), F.lit("")))).cast("long")
    c = lambda k: F.concat(F.lit("C"), (n % k).cast("string"))
    loc = F.concat(F.lit("1#X#"), c(7), F.lit("#a#b#1#2#f;1#Y#"), c(5), F.lit("#a#b#1#2#f;bad#item;1#Z#"), c(7), F.lit("#a#b#1#2#f"))
    tone = F.concat_ws(",", ((n % 200 - 100) / 10).cast("string"), (n % 9).cast("string"), (n % 8).cast("string"), (n % 17).cast("string"), F.lit("0"), F.lit("0"), F.when(n % 6 == 0, "").otherwise((n % 900).cast("string")))
    th = F.concat(F.lit("T"), (n % 3).cast("string"), F.lit(",10;T"), (n % 4).cast("string"), F.lit(",20"))
    s = F.substring("source", 4, 5).cast("int")
    return t.documents.select(
        F.sha1(F.encode("text", "UTF-8")).alias("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 30).cast("int")).alias("date"), W.location_codes(loc).alias("mentions"),
        W.tone_fields(tone).alias("tone"), F.when(s % 8 != 7, F.concat(F.lit("C"), (s % 8).cast("string"))).alias("source_code"), W.theme_names(th).alias("themes"))


DOCS = """raw AS (SELECT sha1(text) AS k, length(text)+7*(length(text)-length(replace(text,'e','')))::BIGINT AS n, substr(source,4)::INT AS s FROM documents), d AS MATERIALIZED (SELECT k, DATE '2024-01-01'+(n%30)::INT AS date, n, min(CASE WHEN s%8<>7 THEN 'C'||(s%8)::VARCHAR END) AS sc, bool_or(s%8=7) AS anynull FROM raw GROUP BY k, n),
  d2 AS (SELECT k, date, n, CASE WHEN anynull THEN NULL ELSE sc END AS sc, (n%200-100)/10.0 AS tone, n%9 AS pos, n%8 AS neg, n%17 AS pol, CASE WHEN n%6=0 THEN 0 ELSE n%900 END AS w FROM d),
  mn AS (SELECT *, 'C'||(n%7)::VARCHAR AS code, CASE WHEN n%7=n%5 THEN 3 ELSE 2 END AS m FROM d2 UNION ALL SELECT *, 'C'||(n%5)::VARCHAR, 1 FROM d2 WHERE n%5<>n%7),
  ed AS MATERIALIZED (SELECT date, code, count(*) AS n_articles, sum(m)::BIGINT AS mentions, sum(w)::DOUBLE AS total_words, avg(tone) AS tone_mean, CASE WHEN sum(w)>0 THEN sum(tone*w)/sum(w) ELSE avg(tone) END AS tone_weighted, avg(pos) AS positive_mean, avg(neg) AS negative_mean, avg(pol) AS polarity_mean, stddev_pop(tone) AS tone_dispersion,
    CASE WHEN sum(w) FILTER (sc=code)>0 THEN sum(tone*w) FILTER (sc=code)/sum(w) FILTER (sc=code) ELSE avg(tone) FILTER (sc=code) END AS local_tone, CASE WHEN sum(w) FILTER (sc<>code)>0 THEN sum(tone*w) FILTER (sc<>code)/sum(w) FILTER (sc<>code) ELSE avg(tone) FILTER (sc<>code) END AS foreign_tone,
    count(*) FILTER (sc=code) AS local_articles, count(*) FILTER (sc<>code) AS foreign_articles, count(*) FILTER (sc IS NULL) AS unknown_articles, quantile_cont(tone,0.1) AS tone_p10, quantile_cont(tone,0.5) AS tone_p50, quantile_cont(tone,0.9) AS tone_p90 FROM mn GROUP BY 1,2),
  sr AS (SELECT date, sc AS code, count(*) AS source_total FROM d2 WHERE sc IS NOT NULL GROUP BY 1,2),
  e2 AS MATERIALIZED (SELECT ed.*, coalesce(source_total,0) AS source_total, (local_articles+foreign_articles)*1.0/n_articles AS resolution_rate, CASE WHEN source_total>0 THEN local_articles*1.0/source_total END AS attention_share FROM ed LEFT JOIN sr USING (date, code))"""
ED_F = "total_words tone_mean tone_weighted positive_mean negative_mean polarity_mean tone_dispersion local_tone foreign_tone tone_p10 tone_p50 tone_p90 resolution_rate attention_share"


@query("A6_entity_day", f"WITH {DOCS} SELECT * FROM e2", ED_F)
def _(t):
    return W.entity_day(documents(t))


@query("T7_theme_shares", f"""WITH {DOCS}, th AS (SELECT date, 'C'||(n%7)::VARCHAR AS code, n FROM d2 UNION ALL SELECT date, 'C'||(n%5)::VARCHAR, n FROM d2 WHERE n%5<>n%7), e AS (SELECT date, code, 'T'||(n%3)::VARCHAR AS th FROM th UNION ALL SELECT date, code, 'T'||(n%4)::VARCHAR FROM th),
   c AS (SELECT date, code, th, count(*) AS c FROM e GROUP BY 1,2,3), r AS (SELECT *, sum(c) OVER (PARTITION BY date,code)::BIGINT AS total, row_number() OVER (PARTITION BY date,code ORDER BY c DESC, th) AS r FROM c)
   SELECT date, code, total AS total_themes, th AS theme, c AS count, r AS rank FROM r WHERE r<=2""")
def _(t):
    d = documents(t).dropDuplicates(["doc_id"]).select("date", F.explode(F.array_distinct("mentions")).alias("code"), "themes").withColumn("theme", F.explode("themes"))
    s = W.theme_shares(d, 2)
    items = F.from_json("top_themes", "array<struct<theme:string,count:long,share:double>>")
    return s.select("date", "code", "total_themes", F.posexplode(items).alias("p", "i")).select("date", "code", "total_themes", "i.theme", "i.count", (F.col("p") + 1).cast("long").alias("rank"))


@query("A7_domain_country", """WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), ':.*$', ''), '^www[0-9]*\\.', '') AS h FROM pages), s AS (SELECT page_id, list_aggregate(string_split(h,'.')[i:], 'string_agg', '.') AS suf, i FROM h, (SELECT unnest(range(1,8)) AS i) WHERE i < len(string_split(h,'.'))),
   l AS (SELECT * FROM (VALUES ('example.com','US'),('example.net','DE'),('m.ththth.example.net','FR')) v(d,c)) SELECT h.page_id, arg_min(c, i) AS source_code FROM h LEFT JOIN s ON s.page_id=h.page_id LEFT JOIN l ON l.d=suf GROUP BY 1""")
def _(t):
    pairs = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("code")) for d, c in (("example.com", "US"), ("example.net", "DE"), ("m.ththth.example.net", "FR"))])
    lookup = t.spark.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    return W.domain_country(t.pages.select("page_id", "url"), ["url"], lookup, "page_id").select("page_id", "source_code")


def signal_days(t):
    return W.entity_day(documents(t)).withColumnRenamed("code", "entity")


def _pz(c, w=8, m=4):
    return f"CASE WHEN count({c}) OVER f >= {m} AND stddev_pop({c}) OVER f > 0 THEN ({c}-avg({c}) OVER f)/stddev_pop({c}) OVER f END"


SD = DOCS + """, x AS (SELECT code AS entity, *, coalesce(local_tone,tone_weighted) AS sentiment_raw, ln(1+local_articles) AS attention FROM e2), x2 AS (SELECT *, sentiment_raw*attention_share AS sxa, -sentiment_raw+0.5*tone_dispersion AS risk_raw FROM x)"""


@query("W41_country_signals", f"""WITH {SD} SELECT entity, date, {_pz('attention')} AS attention_shock, {_pz('sentiment_raw')} AS sentiment, {_pz('risk_raw')} AS risk, {_pz('sxa')} AS sxa_z, date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS days_since_prior FROM x2 WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""", "attention_shock sentiment risk sxa_z")
def _(t):
    s = W.country_signals(signal_days(t), 8, 4)
    return s.select("entity", "date", "attention_shock", "sentiment", "risk", F.col("sentiment_x_attention_z").alias("sxa_z"), F.col("days_since_prior").cast("long").alias("days_since_prior"))


def metronome_input(t):
    m = B.monthly(t).groupBy("date", "entity").agg(*[F.round(F.sum(F.when(F.col("variable") == v, F.col("value"))) / 1e6, 6).alias(v) for v in "ANR"])
    m = m.na.drop()
    return m.select("entity", "date", F.col("A").alias("sentiment_raw"), F.col("N").alias("attention_share"), F.col("R").alias("risk_raw"), (F.col("A") - F.col("N")).alias("tone_dispersion"), (F.col("A") + F.col("R")).alias("local_tone"), (F.col("N") - F.col("R")).alias("foreign_tone"))


def _ew(c, span):
    a = 2.0 / (span + 1)
    return f"list_reduce(array_agg({c}) OVER w, lambda p, q: p*(1-{a!r})+q*{a!r})"


@query("W42_metronome", f"""WITH m AS (SELECT date, entity, round(sum(value) FILTER (variable='A')/1e6,6) AS a, round(sum(value) FILTER (variable='N')/1e6,6) AS n, round(sum(value) FILTER (variable='R')/1e6,6) AS r FROM {{monthly}} GROUP BY 1,2), i AS (SELECT * FROM m WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL),
   e AS (SELECT date, entity, {_ew('a',3)} AS sf, {_ew('a',9)} AS ss, {_ew('n',3)} AS af, {_ew('r',5)} AS rf, {_ew('a-n',5)} AS df, {_ew('n-r',3)} AS ff FROM i WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)), e2 AS (SELECT *, sf-ss AS st FROM e),
   z AS (SELECT date, entity, {", ".join(f"{_pz(c, 24, 12)} AS {c}z" for c in ("sf", "ss", "st", "af", "rf", "df", "ff"))} FROM e2 WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
   SELECT date, entity, 0.35*sfz+0.20*ssz+0.20*stz+0.15*afz-0.10*rfz AS metronome, 0.45*rfz+0.30*dfz-0.15*sfz-0.10*ffz AS risk_composite FROM z""", "metronome risk_composite")
def _(t):
    return W.metronome(metronome_input(t), 3, 9, 5, 24, 12).select("date", "entity", "metronome", "risk_composite")


@query("W42_monthly_metronome")
def _(t):
    return W.metronome(signal_days(t).withColumns({"sentiment_raw": F.coalesce("local_tone", "tone_weighted"), "risk_raw": -F.coalesce("local_tone", "tone_weighted") + 0.5 * F.col("tone_dispersion")}), 5, 10, 7, 8, 1, monthly=True)


@query("W44_ratio_with_fallback", """WITH g AS (SELECT entity, year(date) AS y, arg_max(value,date) AS gdp FROM {sales} GROUP BY 1,2), d AS (SELECT m.date, m.entity, m.value AS v, b.date AS bd, b.value AS den FROM (SELECT * FROM {monthly} WHERE variable='A') m ASOF LEFT JOIN (SELECT * FROM monthly WHERE variable='R' AND month(date)%3=0 AND year(date)>=1997) b ON b.entity=m.entity AND m.date>=b.date)
   SELECT d.date, d.entity, v/coalesce(den, gdp)*100 AS share FROM d LEFT JOIN g ON g.entity=d.entity AND g.y=year(d.date) WHERE coalesce(den,gdp) <> 0""", "share")
def _(t):
    m = B.monthly(t)
    den = m.filter("variable = 'R' AND month(date) % 3 = 0 AND year(date) >= 1997").select("entity", "date", F.col("value").alias("den"))
    d = J.asof(m.filter("variable = 'A'"), den, ["entity"], ["den"])
    d = J.attach_same_year(d, B.sales(t), "gdp").withColumn("d", F.coalesce("den", "gdp")).filter("d <> 0")
    return d.select("date", "entity", (F.col("value") / F.col("d") * 100).alias("share"))


# --- prediction markets: each order is an outcome row of a market ---------------------------

def outcomes(t):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    cents = F.round(p * 100, 0).cast("long")
    prob = (cents % 101) / 100
    return t.orders.select(
        F.concat(F.lit("m"), (k % 500).cast("string")).alias("market_id"), k.alias("outcome_id"), prob.alias("probability"),
        F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "No").when(k % 4 == 2, F.concat((k % 7).cast("string"), F.lit(" to "), (k % 7 + 2).cast("string"))).otherwise(F.concat(F.lit("above "), (k % 9).cast("string"))).alias("label"),
        F.when(k % 5 == 0, (k % 10).cast("double")).alias("threshold_low"), F.when(k % 5 == 0, (k % 10 + 1).cast("double")).alias("threshold_high"), (k % 3).cast("long").alias("sort_order"),
        F.when(k % 6 != 0, p).alias("liquidity"), F.when(k % 7 != 0, p / 10).alias("volume_24h"), F.when(k % 3 != 0, prob - 0.02).alias("bid"), F.when(k % 8 != 0, prob + 0.02).alias("ask"),
        F.when(k % 9 != 0, prob + (k % 5) / 50).alias("last_price"), F.when(k % 10 != 0, F.col("o_orderdate") - F.expr("make_interval(0,0,0,0,cast(o_orderkey % 40 as int))")).alias("last_trade_ts"), F.col("o_orderdate").alias("snapshot_ts"),
        F.element_at(F.array(*[F.lit(x) for x in ("fed_policy", "cpi", "tariff", "oil_shock")]), ((k % 500) % 4 + 1).cast("int")).alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in ("fed_cut_count", "yoy_core", "agreement")]), ((k % 500) % 3 + 1).cast("int")).alias("subcategory"))


OUTC = """o0 AS (SELECT *, o_orderkey AS k, ((round(o_totalprice*100,0)::BIGINT)%101)/100.0 AS prob FROM orders), oc AS (SELECT 'm'||(k%500)::VARCHAR AS market_id, k AS outcome_id, prob AS probability, CASE k%4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN (k%7)::VARCHAR||' to '||(k%7+2)::VARCHAR ELSE 'above '||(k%9)::VARCHAR END AS label,
   CASE WHEN k%5=0 THEN (k%10)+0.5 WHEN k%4=2 THEN k%7+1.0 WHEN k%4=3 THEN (k%9)*1.0 END AS midpoint, k%3 AS sort_order, CASE WHEN k%6<>0 THEN o_totalprice END AS liquidity, CASE WHEN k%7<>0 THEN o_totalprice/10 END AS volume_24h, CASE WHEN k%3<>0 THEN prob-0.02 END AS bid, CASE WHEN k%8<>0 THEN prob+0.02 END AS ask,
   CASE WHEN k%9<>0 THEN prob+(k%5)/50.0 END AS last_price, CASE WHEN k%10<>0 THEN k%40 END AS age_h, ['fed_policy','cpi','tariff','oil_shock'][(k%500)%4+1] AS category, ['fed_cut_count','yoy_core','agreement'][(k%500)%3+1] AS subcategory FROM o0),
   ob AS (SELECT *, coalesce(bid>0 AND ask>bid AND ask-bid<=0.05,false) AS live FROM oc), fl AS MATERIALIZED (SELECT *, (NOT live AND (coalesce(volume_24h,0)<5000 OR coalesce(age_h>24,true))) OR coalesce(abs(last_price-probability)>0.05,false) AS is_stale, (probability>=0.99 OR probability<=0.01) AND (ask IS NULL OR bid IS NULL) AS is_settled,
     CASE WHEN coalesce(liquidity,0)>0 THEN liquidity ELSE coalesce(volume_24h,0) END AS w FROM ob),
   pm AS MATERIALIZED (SELECT * FROM fl WHERE NOT is_settled QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY (lower(label)='yes') DESC, sort_order, probability DESC, outcome_id)=1)"""


def flagged(t):
    return M.quality_flags(outcomes(t), 5000.0)


@query("A31_quality_flags", f"WITH {OUTC} SELECT outcome_id, is_stale, is_settled FROM fl")
def _(t):
    return flagged(t).select("outcome_id", "is_stale", "is_settled")


@query("A19_primary_outcome", f"WITH {OUTC} SELECT market_id, outcome_id, probability FROM pm", "probability")
def _(t):
    return M.primary_outcome(flagged(t), True).select("market_id", "outcome_id", "probability")


@query("A17_weighted_probability", f"WITH {OUTC} SELECT category, sum(probability*w)/sum(w) AS value, count(*) AS n_markets, sum(w) AS total_weight FROM pm WHERE NOT is_stale AND w>0 GROUP BY 1", "value total_weight", digits=4)
def _(t):
    return M.weighted_probability(M.primary_outcome(flagged(t), True), ["category"])


@query("A18_expected_value", f"WITH {OUTC}, m AS (SELECT category, market_id, sum(midpoint*probability) AS e, max(w) AS w FROM fl WHERE NOT is_stale AND midpoint IS NOT NULL AND w>0 GROUP BY 1,2) SELECT category, sum(e*w)/sum(w) AS value, count(*) AS n_markets, sum(w) AS total_weight FROM m GROUP BY 1", "value total_weight", digits=4)
def _(t):
    return M.expected_value(flagged(t), ["category"])


@query("A21_category_confidence", """SELECT o_orderpriority AS category, avg((p-r)**2) AS brier, greatest(0.1,least(1,1-avg((p-r)**2))) AS confidence FROM (SELECT o_orderpriority, coalesce(CASE WHEN o_orderkey%5<>0 THEN (o_orderkey%100)/100.0 END,0.5) AS p, (o_orderkey%2)::DOUBLE AS r FROM orders WHERE o_orderstatus<>'P') GROUP BY 1""", "brier confidence")
def _(t):
    k = F.col("o_orderkey")
    r = t.orders.select(F.col("o_orderpriority").alias("category"), F.when(k % 5 != 0, (k % 100) / 100).alias("p_before"), F.when(F.col("o_orderstatus") != "P", (k % 2).cast("double")).alias("resolution"))
    return M.category_confidence(r)


RULES = (("fed_cut_count_expectation", "fed_policy", "fed_cut", "expectation"), ("cpi_nowcast_yoy_next", "cpi", "yoy", "expectation"), ("oil_shock_prob_30d", "oil_shock", "", "probability"))


@query("A20_global_composites", f"""WITH {OUTC}, e1 AS (SELECT CASE WHEN category='fed_policy' THEN 'fed_cut_count_expectation' ELSE 'cpi_nowcast_yoy_next' END AS signal, market_id, sum(midpoint*probability) AS e, max(w) AS w FROM fl WHERE ((category='fed_policy' AND subcategory='fed_cut_count') OR (category='cpi' AND subcategory='yoy_core')) AND NOT is_stale AND midpoint IS NOT NULL AND w>0 GROUP BY 1,2),
   v AS (SELECT signal, sum(e*w)/sum(w) AS value, count(*) AS n_markets FROM e1 GROUP BY 1 UNION ALL SELECT 'oil_shock_prob_30d', sum(probability*w)/sum(w), count(*) FROM pm WHERE category='oil_shock' AND NOT is_stale AND w>0), nm AS (SELECT unnest({list(M.REQUIRED_GLOBAL)}) AS signal) SELECT nm.signal, value, coalesce(n_markets,0) AS n_markets, CASE WHEN v.signal IS NULL THEN 0.0 ELSE 0.6 END AS confidence FROM nm LEFT JOIN v ON v.signal=nm.signal""", "value confidence")
def _(t):
    conf = t.spark.range(0).select(F.lit("x").alias("category"), F.lit(0.5).alias("confidence"))
    return M.global_composites(flagged(t), RULES, conf, M.REQUIRED_GLOBAL).drop("total_weight")


def spill_payload(t):
    k = F.col("n_nationkey")
    item = lambda c, e, f: F.struct(c.alias("country"), e.alias("elasticity"), F.lit("trade").alias("channel"), f.alias("confidence"))
    pay = F.to_json(F.array(item(F.col("n_name"), (k - 12) / 10, F.when(k % 3 == 0, "High").otherwise("low")), item(F.lit("NATION_0"), (k % 5) / 5.0, F.lit(None).cast("string"))))
    ids = F.explode(F.array(*[F.concat(F.lit("m"), (k * m).cast("string")) for m in (1, 20)]))
    return t.nation.withColumn("spillovers", pay).select(ids.alias("market_id"), "spillovers")


SPL = """n0 AS (SELECT n_name, n_nationkey AS k FROM nation), sp AS (SELECT 'm'||(k*m)::VARCHAR AS market_id, n_name AS entity, (k-12)/10.0 AS elasticity, CASE WHEN k%3=0 THEN 'high' ELSE 'low' END AS confidence FROM n0, (SELECT unnest([1,20]) AS m) UNION ALL SELECT 'm'||(k*m)::VARCHAR, 'NATION_0', (k%5)/5.0, 'medium' FROM n0, (SELECT unnest([1,20]) AS m))"""


@query("A32_spillover_rows", f"WITH {SPL} SELECT market_id, entity, elasticity, 'trade' AS channel, confidence FROM sp", "elasticity")
def _(t):
    return M.spillover_rows(spill_payload(t))


@query("A20_entity_composites", f"""WITH {OUTC}, {SPL}, j AS (SELECT sp.*, pm.probability, pm.w, pm.is_stale, category, subcategory, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END AS c FROM sp JOIN pm USING (market_id)), t AS (SELECT *, w*c*CASE WHEN is_stale THEN 0.25 ELSE 1 END AS tw, CASE WHEN subcategory='agreement' THEN 1-probability ELSE probability END AS tp FROM j WHERE category='tariff'),
   o AS (SELECT entity, sum(probability*elasticity*w*c)/sum(w*c) AS value, count(DISTINCT market_id) AS n_markets FROM j WHERE NOT is_stale AND w*c>0 GROUP BY 1) SELECT entity, sum(tp*tw)/sum(tw) AS value, count(DISTINCT market_id) AS n_markets, 'tariff_intensity' AS signal FROM t WHERE tw>0 GROUP BY 1 UNION ALL SELECT entity, value, n_markets, 'opportunity' FROM o UNION ALL SELECT entity, -value, n_markets, 'risk' FROM o""", "value")
def _(t):
    return M.entity_composites(M.primary_outcome(flagged(t), True), M.spillover_rows(spill_payload(t))).drop("total_weight")


@query("A33_resolution_rows", """WITH s AS (SELECT user_id AS market_id, ts, value AS p FROM events), r AS (SELECT user_id AS market_id, max(ts) AS rt, arg_max(value,ts) AS cur FROM events GROUP BY 1), a AS (SELECT r.*, rt - INTERVAL 24 HOUR AS t24, rt - INTERVAL 1 HOUR AS t1 FROM r),
   b AS (SELECT a.*, s.p AS p24 FROM a ASOF LEFT JOIN s ON s.market_id=a.market_id AND a.t24>=s.ts), c AS (SELECT b.*, s.p AS p1 FROM b ASOF LEFT JOIN s ON s.market_id=b.market_id AND b.t1>=s.ts) SELECT market_id, rt AS resolved_ts, 1.0::DOUBLE AS resolution, coalesce(p24,cur) AS p_24h, coalesce(p1,cur) AS p_1h FROM c""", "resolution p_24h p_1h")
def _(t):
    e = t.events.select(F.col("user_id").alias("market_id"), "ts", F.col("value").alias("p"))
    r = e.groupBy("market_id").agg(F.max("ts").alias("resolved_ts"), F.max_by("p", "ts").alias("probability")).withColumn("resolution", F.lit(1.0))
    return M.resolution_rows(r, e)


def forecasts(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars", "source", "lang"), "doc_id")
    n = F.col("n_chars")
    rep = F.explode(F.array(F.lit(0), F.lit(7), F.lit(31))).alias("r")
    return d.select("lang", "source", F.col("doc_id").alias("market_id"), F.col("quality").cast("double").alias("outcome"), ((n % 89 + 5) / 100).alias("p_mkt"), "n_chars", rep).withColumn("p", ((F.col("n_chars") + F.col("r")) % 97 + 1) / 100)


FC = """f0 AS (SELECT lang, source, doc_id AS market_id, quality::DOUBLE AS outcome, (n_chars%89+5)/100.0 AS p_mkt, ((n_chars+r)%97+1)/100.0 AS p FROM labels JOIN documents USING (doc_id), (SELECT unnest([0,7,31]) AS r)), fs AS MATERIALIZED (SELECT lang, source, market_id, count(*) AS n_samples, max(p_mkt) AS p_mkt, max(outcome) AS outcome, quantile_cont(p,0.5) AS p_fc FROM f0 GROUP BY 1,2,3),
   sc AS (SELECT *, (p_fc-outcome)**2 AS brier, (p_mkt-outcome)**2 AS brier_mkt, -(outcome*ln(p_fc)+(1-outcome)*ln(1-p_fc)) AS logloss, -(outcome*ln(p_mkt)+(1-outcome)*ln(1-p_mkt)) AS logloss_mkt, (p_mkt-outcome)**2-(p_fc-outcome)**2 AS edge FROM fs)"""


def scored(t):
    return M.score_forecasts(forecasts(t), ["lang", "source", "market_id"])


@query("A22_score_forecasts", f"WITH {FC} SELECT * FROM sc", "p_mkt outcome p_fc brier brier_mkt logloss logloss_mkt edge")
def _(t):
    return scored(t)


@query("A23_trade_rule", f"""WITH {FC}, g AS (SELECT sc.*, theta, cost FROM sc, (SELECT unnest([0.05,0.15])::DOUBLE AS theta), (SELECT unnest([0.0,0.02])::DOUBLE AS cost)), p AS (SELECT theta, cost, CASE WHEN p_fc>p_mkt+theta THEN outcome-(p_mkt+cost) WHEN p_fc<p_mkt-theta THEN (1-outcome)-((1-p_mkt)+cost) END AS pnl FROM g)
   SELECT theta, cost, count(*) AS n_trades, avg(pnl) AS mean_pnl, sum(pnl) AS total_pnl, avg((pnl>0)::INT) AS hit_rate, min(pnl) AS worst, avg(pnl)/(stddev_samp(pnl)/sqrt(count(*))) AS t_stat FROM p WHERE pnl IS NOT NULL GROUP BY 1,2""", "mean_pnl total_pnl hit_rate worst t_stat")
def _(t):
    return M.trade_rule(scored(t), [0.05, 0.15], [0.0, 0.02])


@query("A24_calibration_slices", f"WITH {FC} SELECT 'lang' AS slice, lang AS slice_value, count(*) AS n, avg(outcome) AS hit_rate, avg(brier) AS brier FROM sc GROUP BY 2 UNION ALL SELECT 'source', source, count(*), avg(outcome), avg(brier) FROM sc GROUP BY 2", "hit_rate brier")
def _(t):
    return M.calibration_slices(scored(t), ["lang", "source"])


@query("A24_calibration_curve", f"WITH {FC} SELECT CASE WHEN p_fc<0.25 THEN '[0.00, 0.25)' WHEN p_fc<0.5 THEN '[0.25, 0.50)' WHEN p_fc<0.75 THEN '[0.50, 0.75)' ELSE '[0.75, 1.01)' END AS bucket, count(*) AS n, avg(outcome) AS realised, avg(p_fc) AS stated FROM sc GROUP BY 1", "realised stated")
def _(t):
    return M.calibration_curve(scored(t), [0.0, 0.25, 0.5, 0.75, 1.01])


@query("A39_live_scoring", f"WITH {FC} SELECT market_id, p_fc, brier FROM sc WHERE market_id % 5 <> 0", "p_fc brier")
def _(t):
    f = forecasts(t)
    out = t.labels.select(F.col("doc_id").alias("market_id"), F.col("quality").cast("double").alias("outcome"))
    stored = t.documents.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("market_id"))
    return M.score_resolved(f, out, stored, ["market_id"]).select("market_id", "p_fc", "brier")


# --- strategies ---------------------------------------------------------------------------

REGW = f"""WITH {IC}, {RG}, m AS (SELECT regime, signal AS variable, avg(ic) AS mean_ic FROM ic JOIN rt USING (date) WHERE horizon=1 GROUP BY 1,2), sw AS (SELECT *, greatest(0, 0.7*mean_ic+0.3*avg(mean_ic) OVER (PARTITION BY regime)) AS s FROM m),
   rw AS MATERIALIZED (SELECT regime, variable, mean_ic, CASE WHEN sum(s) OVER r>0 THEN s/sum(s) OVER r ELSE 1.0/count(*) OVER r END AS weight FROM sw WINDOW r AS (PARTITION BY regime))"""


def regime_weights(t):
    from ..plans import harness as H
    ic = settle(H.rank_ic(H.align_monthly(signals(t), B.mret(t), [1]))).join(R.tag_regimes(macro(t)).select("date", "regime"), "date")
    return P.walk_forward_weights(ic.withColumnRenamed("signal", "variable"), 0.3)


@query("F8_regime_weights", REGW + " SELECT * FROM rw", "mean_ic weight")
def _(t):
    return regime_weights(t)


@query("F8_regime_quintile_spread", REGW + """, hv AS (SELECT date, variable, weight FROM (SELECT DISTINCT date, signal AS variable FROM s0) JOIN rt USING (date) JOIN rw USING (regime, variable)), hn AS (SELECT *, CASE WHEN sum(weight) OVER d>0 THEN weight/sum(weight) OVER d ELSE 1.0/count(*) OVER d END AS w FROM hv WINDOW d AS (PARTITION BY date)),
   co AS (SELECT s0.date, entity, sum(value*w) AS score FROM s0 JOIN hn ON hn.date=s0.date AND hn.variable=s0.signal GROUP BY 1,2), j AS (SELECT co.*, ret, row_number() OVER (PARTITION BY co.date ORDER BY score, co.entity) AS p, count(*) OVER (PARTITION BY co.date) AS n FROM co JOIN mret USING (date, entity))
   SELECT date, avg(ret) FILTER (p > 1+(n-1)*4/5.0) - avg(ret) FILTER (p <= 1+(n-1)/5.0) AS ret_ls, any_value(n) AS n FROM j WHERE n>=10 GROUP BY 1""".replace("s0", "s"), "ret_ls")
def _(t):
    s = signals(t).withColumnRenamed("signal", "variable")
    c = P.composite_scores(s, regime_weights(t), R.tag_regimes(macro(t)).select("date", "regime"))
    return P.quintile_spread(c, B.mret(t))


@query("F9_month_end_portfolio", """WITH q AS (SELECT max(date) AS r FROM {dret} GROUP BY date_trunc('quarter', date)), k AS (SELECT r, lead(r) OVER (ORDER BY r) AS nx FROM q),
   l AS (SELECT k.r, d.entity, arg_max(d.value, d.date) AS score FROM k JOIN {daily} d ON d.date < k.r GROUP BY 1,2),
   b AS (SELECT r, entity, 1.0/count(*) OVER (PARTITION BY r) AS w FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, entity) <= 5)),
   g AS (SELECT b.r, k.nx, b.entity, any_value(w) * coalesce(exp(sum(ln(1+x.ret))), 1) AS v FROM b JOIN k ON k.r=b.r LEFT JOIN {dret} x ON x.entity=b.entity AND x.date > b.r AND (k.nx IS NULL OR x.date <= k.nx) GROUP BY 1,2,3),
   t AS (SELECT r, sum(v) AS t FROM g GROUP BY 1), o AS (SELECT g.nx AS r, entity, v/t AS old FROM g JOIN t ON t.r=g.r WHERE g.nx IS NOT NULL),
   c AS (SELECT coalesce(b.r, o.r) AS r, sum(abs(coalesce(w,0)-coalesce(old,0)))/2 AS turnover FROM b FULL JOIN o ON o.r=b.r AND o.entity=b.entity GROUP BY 1)
   SELECT t.r AS rebalance, t-1 AS period_return, turnover FROM t JOIN c ON c.r=t.r""", "period_return turnover")
def _(t):
    d = B.daily(t).select("date", "entity", "value")
    reb = B.dret(t).groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("date")).select("date")
    return P.month_end_portfolio(d, B.dret(t), 5, reb)


@query("F10_selection_funnel", """WITH f AS (SELECT entity AS base, 'CS' AS v, date, ret AS x FROM {mret} UNION ALL SELECT entity, 'TS', date, ret*0.9+0.0001 FROM mret), n AS (SELECT *, row_number() OVER (PARTITION BY base, v ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY base, v) AS n FROM f WHERE base LIKE 'NATION_1%' OR base LIKE 'NATION_2%'), h AS (SELECT *, CASE WHEN i<=floor(n/2) THEN 1 ELSE 2 END AS h FROM n),
   s AS (SELECT base, v, count(*) AS n, count(*) FILTER (h=1) AS n1, count(*) FILTER (h=2) AS n2, avg(x)/stddev_samp(x)*sqrt(12) AS sh, avg(x) FILTER (h=1)/stddev_samp(x) FILTER (h=1)*sqrt(12) AS s1, avg(x) FILTER (h=2)/stddev_samp(x) FILTER (h=2)*sqrt(12) AS s2 FROM h GROUP BY 1,2) SELECT base, min(n) AS n_obs, min(sh) AS min_sharpe, min(least(s1,s2)) AS min_half_sharpe FROM s GROUP BY 1 HAVING count(*)=2""", "min_sharpe min_half_sharpe")
def _(t):
    m = B.mret(t)
    f = m.select(F.concat("entity", F.lit("_CS")).alias("factor"), "date", F.col("ret").alias("value")).unionByName(m.select(F.concat("entity", F.lit("_TS")).alias("factor"), "date", (F.col("ret") * 0.9 + 0.0001).alias("value")))
    return P.half_sample_funnel(f, "^NATION_(1|2)").select("base", "n_obs", "min_sharpe", "min_half_sharpe")


@query("F12_walk_forward_ridge")
def _(t):
    return P.walk_forward_ridge(B.monthly(t), B.mret(t), ["A", "N", "R"], 1.0, 3)
