"""Shards against their law, the plain SQL and odd tables."""
import random
import zlib
from fractions import Fraction

import duckdb
import pandas as pd

from check_oracle import compare
from panelyard.llm import queries, sharding, sql
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)


def texts(n, seed):
    rng = random.Random(seed)
    hot = "the hot text " * 20
    return [(i, rng.choice([hot, "x" * min(4000, int(rng.paretovariate(0.8) * 5)), f"é{i} " * 9])) for i in range(n)]


def shards(df, n=8, **how):
    out = {}
    for r in sharding.place(df, n, **how).collect():
        out.setdefault(r.shard, []).append(r)
    return out


def test_query_is_the_plain_sql(spark, tmp_path):
    data = texts(700, 1) + [(None, None), (9005, None), (9006, ""), (9006, "")]
    spark.createDataFrame(data, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_sharding(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert compare(got, con.execute(sql.sharding()).df()) == "ok"
    want = {i: zlib.crc32((t or "").encode()) for i, t in data if i is not None}
    assert all(r.text_crc32 == want[r.doc_id] for r in got.itertuples() if r.doc_id == r.doc_id)


def test_law_of_bytes(spark, rows):
    data = texts(2000, 2)
    for tolerance in (Fraction(0), Fraction(1, 1000), Fraction(1, 20)):
        got = shards(rows(data).repartition(7), 8, tolerance=tolerance, piece_bytes=5_000)
        assert sorted(r.doc_id for g in got.values() for r in g) == list(range(2000))
        size = {k: sum(r["size"] for r in g) for k, g in got.items()}
        mean = sum(size.values()) / 8
        assert all(abs(v - mean) <= 2 * float(tolerance) * mean + 4002 for v in size.values())
        for g in got.values():
            assert sorted(r.slot for r in g) == list(range(len(g)))
    # Copies are cut only by boundaries: a text is in neighbouring shards or in one.
    at = {}
    for k, g in got.items():
        for r in g:
            at.setdefault(r.text, set()).add(k)
    cut = [v for v in at.values() if len(v) > 1]
    assert len(cut) <= 2 and all(max(v) - min(v) == len(v) - 1 for v in at.values())


def test_rounds_reach_one_row(spark, rows):
    data = [(i, "same text") for i in range(40)]
    got = shards(rows(data), 4, tolerance=Fraction(0))
    assert [len(got[k]) for k in range(4)] == [10] * 4


def test_odd_tables(spark, rows, odd, tmp_path):
    clash = odd.withColumn("shard", odd["kept"]).withColumn("h", odd["kept"]).withColumn("S", odd["kept"]).withColumn("piece", odd["kept"]).withColumn("at", odd["kept"]).withColumn("before", odd["kept"])
    got = sharding.place(clash, 3)
    assert got.columns == [c for c in clash.columns if c != "shard"] + ["size", "shard", "slot"]
    back = got.collect()
    assert len(back) == odd.count() and all(r.h == r.S == r.piece == r.at == r.before == "clash" for r in back)
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in back)
    assert sharding.place(rows([]), 8).count() == 0
    assert [r.shard for r in sharding.place(rows([(None, None)]), 8).collect()][0] in range(8)
    assert sorted(r.slot for r in sharding.place(rows([(1, "a")] * 5), 1).collect()) == list(range(5))
    sharding.write_shards(odd, f"{tmp_path}/out", 3)
    assert spark.read.parquet(f"{tmp_path}/out").count() == odd.count()
