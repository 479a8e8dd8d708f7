import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.sources import landing as L
from panelyard.sources import ledgers as G
from panelyard.sources import merge as M
from panelyard.sources import schemas as S
from panelyard.streaming import jobs as ST

ROWS = [(dt.date(2000, 1, 1), "A", 1.5, "V", "s"), (dt.date(2000, 2, 1), "B", 2.5, "V", "s")]


def tidy(spark):
    return spark.createDataFrame(ROWS, S.TIDY)


def test_csv_parquet_fallback_and_typed_empty(spark, tmp_path):
    tidy(spark).write.csv(str(tmp_path / "p.csv"), header=True)
    M.export_parquet(tidy(spark), str(tmp_path / "q"))
    assert L.read_csv_panel(spark, str(tmp_path / "p.csv")).count() == 2
    d = L.read_first_available(spark, [str(tmp_path / "none.csv"), str(tmp_path / "q")])
    assert d.schema == S.TIDY and d.count() == 2
    e = L.read_first_available(spark, [str(tmp_path / "none")])
    assert e.schema == S.TIDY and e.count() == 0


def test_nan_and_inf_become_null(spark, tmp_path):
    spark.createDataFrame([(dt.date(2000, 1, 1), "A", float("nan"), "V", "s"), (dt.date(2000, 1, 1), "B", float("inf"), "V", "s")], S.TIDY).write.parquet(str(tmp_path / "n"))
    assert L.read_panel(spark, str(tmp_path / "n")).filter("value IS NULL").count() == 2


def test_vintages_are_immutable_and_hash_order_free(spark, tmp_path):
    m = M.snapshot_vintage(tidy(spark), str(tmp_path / "v"), "2000-01").first()
    assert m["n_rows"] == 2 and m["content_hash"] == M.vintage_manifest(tidy(spark).orderBy(F.desc("date")), "x").first()["content_hash"]
    with pytest.raises(Exception):
        M.snapshot_vintage(tidy(spark), str(tmp_path / "v"), "2000-01")


def test_partition_overwrite_touches_only_its_slices(spark, tmp_path):
    p = str(tmp_path / "t")
    d = tidy(spark).withColumn("source", F.when(F.col("entity") == "A", "a").otherwise("b"))
    M.write_partitions(d, p, ["source"])
    M.write_partitions(d.filter("source = 'a'").withColumn("value", F.lit(9.0)), p, ["source"])
    assert {r["entity"]: r["value"] for r in spark.read.parquet(p).collect()} == {"A": 9.0, "B": 2.5}
    M.archive({"x": d, "y": d}, str(tmp_path / "arch"))
    assert spark.read.parquet(str(tmp_path / "arch" / "y")).count() == 2


def test_ledger_append_and_corrupt_line(spark, tmp_path):
    p = str(tmp_path / "led")
    ev = spark.createDataFrame([("H1", 1, "open")], "id string, seq int, event string")
    G.append_events(ev, p)
    G.append_events(ev.withColumn("seq", F.lit(2)), p)
    assert G.read_ledger(spark, p, ev.schema).count() == 2
    bad = tmp_path / "bad.json"
    bad.write_text('{"id": "H1", "seq": 1, "event": "open"}\n{"id": ')
    with pytest.raises(Exception):
        G.read_ledger(spark, str(bad), ev.schema).collect()


def test_range_gate_refuses_unit_errors(spark):
    d = spark.createDataFrame([("E", "FX_VOL", float(v)) for v in (5, 6, 7, 900)], "entity string, variable string, value double")
    kept, gate = L.range_gate(d, {"FX_": (0, 100)})
    assert kept.count() == 3
    with pytest.raises(ValueError):
        L.assert_gate(gate)


def write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def drain(spark, df, folder):
    """One run over the available input into a parquet sink; state and sink are kept."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def test_upsert_sink_latest_batch_wins(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "k string, v double"
    write_batches(spark, src, [[("a", 1.0), ("b", 1.0)]], schema)
    sink = ST.upsert_sink(["k"], out)

    def run():
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    write_batches(spark, src, [[("a", 2.0)]], schema)
    run()
    assert {r["k"]: r["v"] for r in ST.read_upserts(spark, out, ["k"]).collect()} == {"a": 2.0, "b": 1.0}


def test_late_and_duplicate_documents_drop(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "id string, ts timestamp, value double"
    src = tmp_path / "docs"
    job = lambda: drain(spark, ST.document_day(spark.readStream.schema(schema).parquet(str(src)).withColumn("g", F.lit("x")), "id", "ts", ["g"], "1 day"), tmp_path)
    write_batches(spark, src, [[("a", t(1), 1.0), ("a", t(1, 1), 1.0), ("b", t(1, 2), 3.0)]], schema)
    job()
    write_batches(spark, src, [[("c", t(10), 5.0)]], schema)
    assert {r["date"]: r["n_articles"] for r in job().collect()} == {dt.date(2024, 1, 1): 2}
    write_batches(spark, src, [[("d", t(1, 5), 7.0), ("e", t(20), 1.0)]], schema)
    second = {r["date"]: r["n_articles"] for r in job().collect()}
    assert second == {dt.date(2024, 1, 1): 2, dt.date(2024, 1, 10): 1}


def at(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day - 1)


def test_detector_state_across_batches(spark, tmp_path):
    schema = "detector string, entity string, ts timestamp, severity double"
    src = tmp_path / "det"
    job = lambda: drain(spark, ST.detector_states(spark.readStream.schema(schema).parquet(str(src)), lateness="1 day"), tmp_path)
    write_batches(spark, src, [[("D1", "E", at(1), 2.0), ("D1", "E", at(2), 2.5), ("X", "E", at(3), None)]], schema)
    job()
    # the second row of day 2 is in time; day 1 is closed by then and its late row drops
    write_batches(spark, src, [[("D1", "E", at(2, 9), 3.0), ("D1", "E", at(4), None)], [("D1", "E", at(1, 3), 99.0), ("D1", "E", at(5), 1.0), ("X", "E", at(9), None)]], schema)
    b = [(r["status"], r["days_active"], r["severity"]) for r in job().orderBy("date").collect()]
    assert b == [("new", 1, 2.0), ("intensifying", 2, 3.0), ("resolved", 2, 0.0), ("new", 1, 1.0)]


def test_arrival_order_does_not_matter(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("D", f"e{k}", at(d, h), float(rng.normal(2, 1)) if rng.random() < 0.7 else None) for k in range(3) for d in range(1, 15) for h in (1, 9, 20)] + [("Z", "z", at(60), None)]
    schema = "detector string, entity string, ts timestamp, severity double"
    out = []
    for n, order in enumerate(([*range(len(rows))], rng.permutation(len(rows)))):
        src, files = tmp_path / f"in{n}", 1 if n == 0 else 5
        write_batches(spark, src, [[rows[i] for i in order[f::files]] for f in range(files)], schema)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        out.append(sorted(map(str, ST.run_to_end(ST.detector_states(s, lateness="70 days"), str(tmp_path / f"run{n}")).collect())))
    assert out[0] == out[1]
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in1"))
    got = ST.run_to_end(ST.detector_states(s.withColumn("ts", F.col("ts")), lateness="59 days"), str(tmp_path / "wide"))
    one = spark.readStream.schema(schema).parquet(str(tmp_path / "in0"))
    assert sorted(map(str, got.collect())) == sorted(map(str, ST.run_to_end(ST.detector_states(one, lateness="59 days"), str(tmp_path / "one")).collect()))


def test_episode_stream_matches_a_loop(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"k{k}", at(i + 1), bool(rng.random() < 0.2), float(rng.normal(0.004, 0.02))) for k in range(5) for i in range(60)]
    schema = "episode_key string, ts timestamp, trigger boolean, ret double"
    src = tmp_path / "ep"
    write_batches(spark, src, [rows + [("end", at(99), False, 0.0)]], schema)
    got = ST.run_to_end(ST.episode_events(spark.readStream.schema(schema).parquet(str(src)), 0.03, 20, lateness="1 day"), str(tmp_path / "cp")).toPandas()
    want = []
    for k in sorted({r[0] for r in rows}):
        inst, opened, cum = 0, None, 0.0
        for _, ts, trig, ret in [r for r in rows if r[0] == k]:
            day = ts.date()
            if opened is None:
                if trig:
                    inst, opened, cum = inst + 1, day, 0.0
                    want.append((k, day, inst, "open"))
                continue
            cum = (1 + cum) * (1 + ret) - 1
            e = "absorbed" if cum >= 0.03 else "expired" if (day - opened).days > 20 else "mark"
            want.append((k, day, inst, e))
            opened = None if e != "mark" else opened
    assert sorted(map(tuple, got[["episode_key", "date", "instance", "event"]].values.tolist())) == sorted(want)


def keyed_state(q):
    """Rows of the keyed operator's state after each batch."""
    return [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]


def one_a_batch(spark, src, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_silent_detectors_leave_the_state(spark, tmp_path):
    schema = "detector string, entity string, ts timestamp, severity double"
    src = tmp_path / "in"
    days = [[("D", f"e{k}", at(d), 2.0) for k in range(20 if d < 3 else 1)] for d in (1, 2, 5, 9, 13)]
    write_batches(spark, src, [*days, [("D", "e7", at(30), 1.0)], [("D", "e0", at(40), None)]], schema)
    q = ST.drain(ST.detector_states(one_a_batch(spark, src, schema), lateness="1 day", expiry=5), str(tmp_path / "run"))
    sizes = keyed_state(q)
    assert max(sizes) >= 20 and sizes[-1] <= max(sizes) // 5
    got = spark.read.parquet(str(tmp_path / "run" / "out")).filter("entity = 'e7'").orderBy("date").collect()
    assert [(r["date"].day, r["status"]) for r in got] == [(1, "new"), (2, "persisting"), (30, "new")]


def test_keys_share_the_state_of_their_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKETS", 2, raising=False)
    schema = "detector string, entity string, ts timestamp, severity double"
    src, names = tmp_path / "in", [None, *(f"e{k}" for k in range(39))]
    write_batches(spark, src, [[("D", e, at(d), s) for e in names] for d, s in ((1, 2.0), (2, 1.0), (5, None))] + [[("D", "x", at(9), None)]], schema)
    q = ST.drain(ST.detector_states(one_a_batch(spark, src, schema), lateness="1 day"), str(tmp_path / "run"))
    assert 1 <= max(keyed_state(q)) <= 6  # two state rows and their timers, not 40
    got = spark.read.parquet(str(tmp_path / "run" / "out")).collect()
    want = [(1, "new", 2.0, 1), (2, "fading", 1.0, 2), (5, "resolved", 0.0, 2)]
    assert {(r["entity"], r["date"].day, r["status"], r["severity"], r["days_active"]) for r in got} == {(e, *w) for e in names for w in want}
    assert len(got) == 120


def test_closed_episodes_and_silent_entities_leave_the_state(spark, tmp_path):
    schema = "episode_key string, ts timestamp, trigger boolean, ret double"
    src = tmp_path / "ep"
    first = [[(f"k{k}", at(1), k < 15, 0.0) for k in range(30)], [(f"k{k}", at(2), False, 0.05) for k in range(30)]]
    later = [[("k0", at(d), d in (6, 30), 0.05)] for d in (5, 6, 7, 15, 30, 31, 45, 60)]
    write_batches(spark, src, first + later, schema)
    q = ST.drain(ST.episode_events(one_a_batch(spark, src, schema), lateness="1 day", forget=10), str(tmp_path / "run"))
    sizes = keyed_state(q)
    # a state row and two of its timer: keys without an episode have none
    assert 15 <= max(sizes) <= 45 and sizes[-1] <= 3
    got = spark.read.parquet(str(tmp_path / "run" / "out")).filter("episode_key = 'k0'").orderBy("date").collect()
    assert [(r["date"], r["instance"], r["event"]) for r in got] == [
        (at(d).date(), i, e) for d, i, e in ((1, 1, "open"), (2, 1, "absorbed"), (6, 2, "open"), (7, 2, "absorbed"), (30, 1, "open"), (31, 1, "absorbed"))]
    schema = "entity string, ts timestamp, value double"
    src = tmp_path / "sm"
    write_batches(spark, src, [[(f"e{k}", at(1), 4.0) for k in range(30)], *[[("e0", at(d), 2.0)] for d in (5, 9, 13, 40, 60)]], schema)
    q = ST.drain(ST.smoothed(one_a_batch(spark, src, schema), span=3, lateness="1 day", forget=10), str(tmp_path / "smooth"))
    sizes = keyed_state(q)
    assert max(sizes) >= 30 and sizes[-1] <= 4
    got = spark.read.parquet(str(tmp_path / "smooth" / "out")).filter("entity = 'e0'").orderBy("date").collect()
    assert [r["ewm"] for r in got][:5] == [4.0, 3.0, 2.5, 2.25, 2.0]


def test_bounded_replay_closes_what_the_watermark_leaves_open(spark, tmp_path):
    schema = "detector string, entity string, ts timestamp, severity double"
    src = tmp_path / "in"
    write_batches(spark, src, [[("D", "e", at(d), 2.0)] for d in (3, 1, 2)], schema)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = ST.replay_to_end(s, "ts", lambda e: ST.detector_states(e, lateness="5 days"), str(tmp_path / "all"))
    assert [(r["date"].day, r["status"]) for r in got.orderBy("date").collect()] == [(1, "new"), (2, "persisting"), (3, "persisting")]
    sessions = ST.replay_to_end(s, "ts", lambda e: ST.activity_sessions(e, "entity", "ts", "12 hours"), str(tmp_path / "sessions"))
    assert [(r["entity"], r["n"]) for r in sessions.collect()] == [("e", 1)] * 3


def test_upserts_fold_across_compaction(spark, tmp_path):
    sink, path = ST.upsert_sink(["k"], str(tmp_path / "u"), ["s"], every=2), str(tmp_path / "u")
    for epoch in range(5):
        sink(spark.createDataFrame([("a", epoch, float(epoch)), ("a", epoch - 1, -1.0), (f"k{epoch}", 0, float(epoch))], "k string, s int, v double"), epoch)
    got = {r["k"]: r["v"] for r in ST.read_upserts(spark, path, ["k"], ["s"]).collect()}
    assert got == {"a": 4.0, **{f"k{e}": float(e) for e in range(5)}}


def test_day_status(spark):
    exp = spark.createDataFrame([(dt.date(2024, 1, i), 4) for i in (1, 2, 3)], "date date, n_files int")
    seen = spark.createDataFrame([(dt.date(2024, 1, 1), 4), (dt.date(2024, 1, 2), 1)], "date date, n_seen int")
    assert [r["status"] for r in ST.day_status(exp, seen).orderBy("date").collect()] == ["ok", "partial", "missing"]
