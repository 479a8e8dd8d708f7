"""Read functions, contracts and streaming replays."""
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import markets as M
from ..operators import portfolio as P
from ..plans import contracts as C
from ..plans import reads as Q
from ..session import checkpoint_folder
from ..streaming import jobs as ST
from . import base as B
from .base import query, registered
from .join_queries import SHOCKS, shocks, tidy
from .market_queries import OUTC, SPL, flagged, spill_payload
from .panel_queries import CONTRIB_SQL, _signal
from .study_queries import scanned, SCAN


@query("Q1_event_window", """SELECT variable, count(value) AS n_days, sum(value) FILTER (date < DATE '2024-01-15') AS pre_sum, sum(value) FILTER (date >= DATE '2024-01-15') AS post_sum, sum(value) AS window_sum, max(value) FILTER (date = DATE '2024-01-15') AS at_date
   FROM {user_daily} WHERE entity=7 AND variable IN ('click','view') AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' GROUP BY 1""", "pre_sum post_sum window_sum at_date")
def _(t):
    return Q.event_window(B.user_daily(t), 7, "2024-01-15", 5, 10, ["click", "view"])


@query("Q2_events_in_window", f"""SELECT * FROM {SHOCKS} WHERE event_date <= DATE '2024-01-22' AND coalesce(end_date,event_date) >= DATE '2024-01-05' AND category='policy' AND severity IN (3,5) AND (is_global OR list_contains(string_split(countries_affected, ', '),'U1')) AND list_has_any(string_split(tags, ','),['odd'])""")
def _(t):
    return Q.events_in_window(shocks(t), "2024-01-05", "2024-01-22", "U1", "policy", [3, 5], ["odd"])


@query("Q3_J14_market_snapshot", f"""WITH {OUTC}, sn AS (SELECT outcome_id, market_id, probability, CAST(o_orderdate AS DATE) AS snapshot_date FROM fl JOIN orders ON o_orderkey=outcome_id), me AS (SELECT DISTINCT market_id, category FROM fl)
   SELECT sn.*, category, DATE '2002-01-01' AS end_date, label, DATE '2002-01-01'-snapshot_date AS days_to_end FROM sn LEFT JOIN me USING (market_id) LEFT JOIN (SELECT market_id, outcome_id, label FROM fl) o USING (market_id, outcome_id) WHERE snapshot_date=(SELECT max(snapshot_date) FROM sn)""", "probability")
def _(t):
    f = flagged(t)
    sn = f.select("market_id", "outcome_id", "probability", F.to_date("snapshot_ts").alias("snapshot_date"))
    meta = f.select("market_id", "category", F.lit("2002-01-01").cast("date").alias("end_date")).distinct()
    return Q.market_snapshot(sn, meta, f.select("market_id", "outcome_id", "label"))


@query("Q4_entity_signal_now", f"""WITH {OUTC}, {SPL} SELECT market_id, 'trade' AS channel, probability, elasticity, probability*elasticity*CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END AS effect FROM sp JOIN pm USING (market_id) WHERE entity='NATION_0'""", "probability elasticity effect")
def _(t):
    return Q.entity_signal_now(M.primary_outcome(flagged(t), True).select("market_id", "probability"), M.spillover_rows(spill_payload(t)), "NATION_0", ["trade"])


@query("Q5_markets_about", """SELECT p_partkey AS market_id, p_name AS question, q FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey=p_partkey WHERE contains(lower(p_name),'widget')""", "q")
def _(t):
    s = t.lineitem.groupBy(F.col("l_partkey").alias("market_id")).agg(F.sum("l_quantity").alias("q"))
    return Q.markets_about(t.part.select(F.col("p_partkey").alias("market_id"), F.col("p_name").alias("question")), s, "Widget")


@query("Q6_commodity_series", """SELECT date, upper(variable)||'_LEVEL' AS variable, sum(value) AS value FROM {monthly} WHERE variable IN ('A','R') AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1,2""", "value", digits=4)
def _(t):
    p = B.monthly(t).groupBy("date", F.concat("variable", F.lit("_LEVEL")).alias("variable")).agg(F.sum("value").alias("value"))
    return Q.commodity_series(p, ["a", "r"], "level", "1999-01-01", "1999-12-31")


@query("Q7_daily_series", """SELECT date, variable, value FROM {daily} WHERE entity='NATION_8' AND date BETWEEN DATE '1999-01-01' AND DATE '2000-06-30'""", "value", digits=4)
def _(t):
    return Q.daily_series(B.daily(t), "NATION_8", ["REV"], "1999-01-01", "2000-06-30")


@query("Q8_entity_returns_latest", """SELECT date, entity, ret FROM {mret} WHERE date=(SELECT max(date) FROM mret WHERE date<=DATE '2001-06-15') ORDER BY ret DESC, entity LIMIT 10""", "ret")
def _(t):
    return Q.entity_returns(B.mret(t), end="2001-06-15", latest_only=True, limit=10).select("date", "entity", "ret")


@query("Q9_factor_returns_window", """SELECT entity AS factor, sum(ret) AS total, count(ret) AS n_periods FROM {mret} WHERE date >= (SELECT date_trunc('year',max(date)) FROM mret) GROUP BY 1 ORDER BY total DESC, factor LIMIT 8""", "total")
def _(t):
    return Q.factor_returns(B.mret(t).select("date", F.col("entity").alias("factor"), F.col("ret").alias("value")), "ytd", n=8)


@query("Q10_return_leaders", """SELECT entity AS name, sum(ret) AS total, count(ret) AS n_periods FROM {mret} WHERE date >= (SELECT max(date) - INTERVAL 11 MONTH FROM mret) GROUP BY 1 ORDER BY total, name LIMIT 6""", "total")
def _(t):
    return Q.return_leaders(B.mret(t), None, "entity", "12m", "laggards", 6)


@query("Q11_prior_snapshot", f"WITH {SCAN} SELECT factor, normalization, horizon, mode, direction, confidence FROM sc WHERE entity='NATION_3' AND thresholds='pit' AND confidence>=0.1", "confidence", digits=3)
def _(t):
    return Q.prior_snapshot(scanned(t), "NATION_3", 0.1).select("factor", "normalization", "horizon", "mode", "direction", "confidence")


@query("Q12_factor_snapshot", """SELECT entity, variable, arg_max(value,date) AS value, max(date) AS date, row_number() OVER (ORDER BY arg_max(value,date) DESC, entity) AS rank FROM {monthly} WHERE variable='N' GROUP BY 1,2""", "value", digits=4)
def _(t):
    return Q.factor_snapshot(A.state_vector(B.monthly(t)), "N")


@query("Q12_region_factors_wide", """SELECT date, avg(ret) FILTER (n_regionkey=2) AS "MKT", stddev_samp(ret) FILTER (n_regionkey=2) AS "DISP" FROM {mret} JOIN nation ON n_name=entity WHERE n_regionkey=2 GROUP BY 1""", "MKT DISP")
def _(t):
    reg = t.nation.select(F.col("n_name").alias("entity"), F.col("n_regionkey").alias("region"))
    r = B.mret(t).join(reg, "entity").groupBy("date", "region").agg(F.avg("ret").alias("MKT"), F.stddev_samp("ret").alias("DISP"))
    f = r.unpivot(["date", "region"], ["MKT", "DISP"], "factor", "value")
    who = reg.filter("region = 2").orderBy("entity").limit(1)
    name = t.nation.filter("n_regionkey = 2").agg(F.min("n_name")).first()[0]
    return Q.region_factor_series(f, who, name, ["MKT", "DISP"])


@query("Q13_run_sql", """SELECT variable, count(*) AS n, max(value) AS top FROM {monthly} GROUP BY 1""", "top", digits=4)
def _(t):
    Q.register(t.spark, {"panelyard_monthly": B.monthly(t)})
    return Q.run_sql(t.spark, "SELECT variable, count(*) AS n, max(value) AS top FROM panelyard_monthly GROUP BY variable")


@query("Q15_tidy_contract", """WITH a AS (SELECT count(*) AS r, count(*) FILTER (value IS NULL) AS b, DATE '2001-12-01'-max(date) AS age, count(DISTINCT entity) AS e FROM {monthly}) SELECT rule, 'monthly' AS subject, CASE rule WHEN 'recency' THEN age<=20 WHEN 'not_empty' THEN r>0 WHEN 'coverage' THEN e>=25 ELSE true END AS ok, CASE rule WHEN 'not_empty' THEN r WHEN 'bad_values' THEN b WHEN 'recency' THEN age WHEN 'coverage' THEN e ELSE 0 END::BIGINT AS n
   FROM a, (SELECT unnest(['not_empty','null_keys','bad_values','duplicates','recency','coverage']) AS rule)""")
def _(t):
    return C.tidy_rules(B.monthly(t), "monthly", "2001-12-01", 20, 25)


@query("Q15_alignment_and_returns_first", """SELECT 'aligned_keys' AS rule, 'ret~sales' AS subject, (SELECT count(*) FROM (SELECT DISTINCT entity, date FROM {sales} EXCEPT SELECT entity, date FROM {mret}))=0 AS ok, (SELECT count(*) FROM (SELECT DISTINCT entity, date FROM sales EXCEPT SELECT entity, date FROM mret)) AS n UNION ALL SELECT 'returns_first','panel',true,0""")
def _(t):
    a = C.same_keys(B.mret(t), B.sales(t), ["entity", "date"], "ret~sales")
    return a.unionByName(C.returns_first(tidy(B.monthly(t), "ship"), ["optimizer"], "panel"))


@query("Q15_event_rules", f"""WITH e AS (SELECT * FROM {SHOCKS}) SELECT 'duplicate_ids' AS rule, 'events' AS subject, true AS ok, 0::BIGINT AS n UNION ALL SELECT 'unknown_category','events', count(*) FILTER (category<>'policy')=0, count(*) FILTER (category<>'policy') FROM e UNION ALL SELECT 'bad_severity','events',true,0 UNION ALL SELECT 'end_before_start','events',true,0""")
def _(t):
    return C.event_rules(shocks(t), ["policy"])


# --- streaming: the events table replayed as a stream ----------------------------------------

def event_stream(t):
    """The events file read as a stream (file source)."""
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


LATE = "2 days"
CLOSED = "(SELECT max(ts) - INTERVAL 2 DAY FROM events)"
DAYS = f"WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED}"


def _drain(df, name):
    """Replay into a folder of its own; windows that the watermark has not closed stay out."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return ST.run_to_end(df, f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


@query("ST1_document_day", f"""SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n_articles, sum(value) AS total, stddev_pop(value) AS dispersion FROM events {DAYS} GROUP BY 1,2""", "total dispersion")
def _(t):
    return _drain(ST.document_day(event_stream(t), "event_id", "ts", ["event_type"], LATE), "st1")


@query("ST2_window_prints", f"""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, user_id, arg_min(value,ts) AS first_print, arg_max(value,ts) AS last_print, count(*) AS n FROM events GROUP BY 1,2 HAVING start + INTERVAL 6 HOUR <= {CLOSED}""", "first_print last_print")
def _(t):
    return _drain(ST.window_prints(event_stream(t), "user_id", "ts", "value", lateness=LATE), "st2")


@query("ST7_activity_sessions", f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}""")
def _(t):
    return _drain(ST.activity_sessions(event_stream(t), "user_id", "ts", "12 hours", LATE), "st7")


def user_events(t):
    return as_users(event_stream(t))


@query("ST3_detector_states", f"""WITH s AS (SELECT event_type AS detector, user_id::VARCHAR AS entity, CAST(ts AS DATE) AS date, max(CASE WHEN value>=30 THEN value/30 END) AS sev FROM events {DAYS} GROUP BY 1,2,3), g AS (SELECT *, count(*) FILTER (sev IS NULL) OVER (PARTITION BY detector, entity ORDER BY date) AS grp, lag(sev) OVER (PARTITION BY detector, entity ORDER BY date) AS prev FROM s),
   r AS (SELECT *, row_number() OVER (PARTITION BY detector, entity, grp, sev IS NULL ORDER BY date) AS n, min(date) OVER (PARTITION BY detector, entity, grp, sev IS NULL) AS f FROM g), p AS (SELECT *, lag(n) OVER (PARTITION BY detector, entity ORDER BY date) AS pn, lag(f) OVER (PARTITION BY detector, entity ORDER BY date) AS pf FROM r)
   SELECT detector, entity, date, CASE WHEN sev IS NULL THEN 'resolved' WHEN prev IS NULL THEN 'new' WHEN sev>=1.2*prev THEN 'intensifying' WHEN sev<=0.8*prev THEN 'fading' ELSE 'persisting' END AS status, coalesce(sev,0.0) AS severity, CASE WHEN sev IS NULL THEN pf ELSE f END AS first_seen, CASE WHEN sev IS NULL THEN pn ELSE n END AS days_active FROM p WHERE sev IS NOT NULL OR prev IS NOT NULL""", "severity")
def _(t):
    return _drain(ST.detector_states(user_events(t).drop("value"), lateness=LATE, expiry=10_000), "st3")


@query("ST4_episode_events", f"""WITH RECURSIVE d AS (SELECT event_type||'|'||user_id::VARCHAR AS episode_key, CAST(ts AS DATE) AS date, bool_or(value > 40) AS trigger, sum((value % 7 - 3)/100) AS ret FROM events {DAYS} GROUP BY 1,2),
   n AS (SELECT *, row_number() OVER (PARTITION BY episode_key ORDER BY date) AS i FROM d),
   e AS (SELECT episode_key, date, i, CASE WHEN trigger THEN 1 ELSE 0 END::BIGINT AS instance, CASE WHEN trigger THEN 'open' END AS event, CASE WHEN trigger THEN 0.0 END::DOUBLE AS move, CASE WHEN trigger THEN date END AS opened, 0::BIGINT AS age FROM n WHERE i=1
     UNION ALL SELECT n.episode_key, n.date, n.i, CASE WHEN e.opened IS NULL AND n.trigger THEN e.instance+1 ELSE e.instance END,
       CASE WHEN e.opened IS NULL THEN CASE WHEN n.trigger THEN 'open' END WHEN (1+e.move)*(1+n.ret)-1 >= 0.03 THEN 'absorbed' WHEN n.date-e.opened > 20 THEN 'expired' ELSE 'mark' END,
       CASE WHEN e.opened IS NULL THEN CASE WHEN n.trigger THEN 0.0 END ELSE (1+e.move)*(1+n.ret)-1 END,
       CASE WHEN e.opened IS NULL THEN CASE WHEN n.trigger THEN n.date END WHEN (1+e.move)*(1+n.ret)-1 >= 0.03 OR n.date-e.opened > 20 THEN NULL ELSE e.opened END,
       CASE WHEN e.opened IS NULL THEN 0 ELSE n.date-e.opened END FROM e JOIN n ON n.episode_key=e.episode_key AND n.i=e.i+1)
   SELECT episode_key, date, instance, event, move, age FROM e WHERE event IS NOT NULL""", "move", digits=5)
def _(t):
    d = user_events(t).select(F.concat_ws("|", "detector", "entity").alias("episode_key"), "ts", (F.col("value") > 40).alias("trigger"), ((F.col("value") % 7 - 3) / 100).alias("ret"))
    return _drain(ST.episode_events(d, 0.03, 20, lateness=LATE), "st4")


@query("ST5_latest_batch_wins", """SELECT user_id, event_type, arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1,2""", "value")
def _(t):
    folder = f"{checkpoint_folder(t.spark)}/st5-{uuid.uuid4().hex}"
    sink = ST.upsert_sink(["user_id", "event_type"], f"{folder}/out", ["ts", "event_id"])
    q = event_stream(t).select("user_id", "event_type", "ts", "event_id", "value").writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return ST.read_upserts(t.spark, f"{folder}/out", ["user_id", "event_type"], ["ts", "event_id"]).drop("event_id")


@query("ST6_smoothed_state", f"""WITH s AS (SELECT user_id::VARCHAR AS entity, CAST(ts AS DATE) AS date, avg(value) AS value FROM events {DAYS} GROUP BY 1,2) SELECT entity, date, value, list_reduce(array_agg(value) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), lambda a, x: a*(1-2.0/11)+x*2.0/11) AS ewm,
   CASE WHEN count(value) OVER w >= 5 AND stddev_pop(value) OVER w > 0 THEN (value-avg(value) OVER w)/stddev_pop(value) OVER w END AS z FROM s WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "value ewm z")
def _(t):
    return _drain(ST.smoothed(user_events(t).select("entity", "ts", "value"), 10, 5, lateness=LATE), "st6")


# --- the same replays to their very end: all rows of events ----------------------------------

def _close(t, job, name):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return ST.replay_to_end(event_stream(t), "ts", job, f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}")


def as_users(e):
    return e.select(F.col("event_type").alias("detector"), F.col("user_id").cast("string").alias("entity"), "ts", F.when(F.col("value") >= 30, F.col("value") / 30).alias("severity"), "value")


def as_episodes(e):
    return as_users(e).select(F.concat_ws("|", "detector", "entity").alias("episode_key"), "ts", (F.col("value") > 40).alias("trigger"), ((F.col("value") % 7 - 3) / 100).alias("ret"))


WHOLE = {
    "ST1_document_day": lambda e: ST.document_day(e, "event_id", "ts", ["event_type"], LATE),
    "ST2_window_prints": lambda e: ST.window_prints(e, "user_id", "ts", "value", lateness=LATE),
    "ST3_detector_states": lambda e: ST.detector_states(as_users(e).drop("value"), lateness=LATE, expiry=10_000),
    "ST4_episode_events": lambda e: ST.episode_events(as_episodes(e), 0.03, 20, lateness=LATE),
    "ST6_smoothed_state": lambda e: ST.smoothed(as_users(e).select("entity", "ts", "value"), 10, 5, lateness=LATE),
    "ST7_activity_sessions": lambda e: ST.activity_sessions(e, "user_id", "ts", "12 hours", LATE),
}
CUTS = (f" {DAYS}", f" HAVING start + INTERVAL 6 HOUR <= {CLOSED}", f" HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}")


def _whole(name, job):
    """Register ``name``_all: its SQL is that of ``name`` without the condition on the watermark."""
    q = registered(name)
    sql = q.sql
    for cut in CUTS:
        sql = sql.replace(cut, "")
    query(f"{name}_all", sql, " ".join(q.floats), q.digits)(lambda t: _close(t, job, name[:3].lower()))


for _name, _job in WHOLE.items():
    _whole(_name, _job)
