"""Fingerprints and components by brute force."""
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelyard.llm import simhash
from panelyard.llm.common import components
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def slow_components(fps):
    n = len(fps)
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint_is_spark_hash_majority(spark):
    for t in ["", None, "a", "A b", "One Two THREE four", "x\x0by z\tq", "é É ß w", "a b c " * 50]:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def planted(rng, n):
    out = [rng.getrandbits(64) for _ in range(n)]
    for x in out[:30]:
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            out.append(y)
    ball = rng.getrandbits(64)
    out += [ball ^ sum(1 << b for b in rng.sample(range(20), 3)) for _ in range(80)]
    return sorted(set(out))


@pytest.mark.parametrize("group", [10_000, 4])
def test_edges_connect_all_close_fingerprints(spark, group):
    fps = planted(random.Random(3), 150)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.close_edges(d, group=group)
    at = {x: i for i, x in enumerate(signed)}
    found = edges.collect()
    assert all(bin(fps[at[e.a]] ^ fps[at[e.b]]).count("1") <= 3 for e in found if group > 4)
    got = {r.node: r.root for r in components(edges).collect()}
    want = slow_components(fps)
    mine = [at[got.get(x, x)] for x in signed]
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(want)) == len(set(mine))


def test_rows_and_components(rows, odd):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150", "changed")
    d = rows([(9, base), (4, near), (7, base), (7, base), (1, "quite different text here"), (None, base), (8, None), (3, ""), (2, " \t ")])
    got = simhash.near_duplicates(d)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by == {9: {4}, 4: {4}, 7: {4}, None: {4}, 1: {1}, 8: {2}, 3: {2}, 2: {2}}
    assert got.count() == 9
    kept = simhash.keep_first(d.withColumn("fp", F.lit("clash")))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4] and kept.columns == ["doc_id", "text", "fp"]
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(rows([])).count() == 0 and simhash.keep_first(rows([])).count() == 0
    alone = simhash.keep_first(rows([(None, "lonely words here"), (None, "lonely words here"), (5, "others")]))
    assert sorted(str(r.doc_id) for r in alone.collect()) == ["5", "None"]


def test_one_row_of_each_component_under_repeated_and_missing_ids(rows):
    a, b = " ".join(f"word{i}" for i in range(300)), " ".join(f"other{i}" for i in range(40))
    got = simhash.keep_first(rows([(3, a), (5, a), (5, b), (None, a), (None, "one lonely text"), (None, "another text alone")]))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, a), (5, b), (None, "one lonely text"), (None, "another text alone")]))


def test_components_of_long_paths_and_hubs(spark):
    rng = random.Random(1)
    ids = list(range(120))
    rng.shuffle(ids)
    path = list(zip(ids[:60], ids[1:60]))
    hub = [(ids[60], x) for x in ids[61:100]] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert {got[i] for i in ids[:60]} == {min(ids[:60])} and {got[i] for i in ids[60:100]} == {min(ids[60:100])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 10, 200))
    edges = simhash.forest(fps, 3)
    assert len(edges) == len(fps) - len(set(slow_components(fps.tolist())))
