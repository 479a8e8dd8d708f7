"""Decontamination and substring duplicates by brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from panelyard.llm import chunk_dedup, decontaminate
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)


def edit_rows(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        prev, row = row, [i]
        for j, x in enumerate(t, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != x)))
    return min(row), row.index(min(row))


def test_distance_by_table():
    rng = random.Random(3)
    for _ in range(400):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 20)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 50)))
        k = rng.randint(0, min(6, len(p) - 1))
        best = edit_rows(p, t)
        assert decontaminate.best_match(p, t, k) == (best if best[0] <= k else None)


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcxyz ") + s[i:], s[:i] + rng.choice("qwk") + s[i + 1 :]])
    return s


def test_every_occurrence_within_budget_is_found(spark, rows):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(12)] + [(90, None), (91, " ")]
    docs = []
    for i in range(60):
        body = " ".join(rng.choices(words, k=40))
        if i % 2:
            it = rng.choice(items[:12])[1]
            body += " " + edited(rng, it, rng.randint(0, max(1, len(it) // 12))).upper() + "\n" + " ".join(rng.choices(words, k=20))
        docs.append((i, body))
    want = set()
    for d, t in docs:
        for i, it in items[:12]:
            p = decontaminate.plain(it)
            if edit_rows(p, decontaminate.plain(t))[0] <= len(p) // 16:
                want.add((d, i, edit_rows(p, decontaminate.plain(t))[0]))
    item_table = spark.createDataFrame(items, "item_id int, text string")
    for block in (1 << 20, 200):
        got = decontaminate.find_items(rows(docs), item_table, block_chars=block)
        assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want
        clean = decontaminate.drop_contaminated(rows(docs), item_table, block_chars=block)
        assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}
    assert len(want) > 10


def test_decontamination_odd_rows(spark, odd, rows):
    items = spark.createDataFrame([(1, "no id here"), (1, "no id here"), (2, "ünïcödé fi")], "item_id long, text string")
    got = decontaminate.find_items(odd, items)
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(None, 1), (None, 1)]
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count() - 1
    assert decontaminate.find_items(rows([]), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(odd, none).count() == 0 and decontaminate.drop_contaminated(odd, none).count() == odd.count()


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_by_definition_and_cuts():
    rng = random.Random(2)
    t = prose(rng, 300).encode()
    h = chunk_dedup.gear_hash(np.frombuffer(t, np.uint8))
    for i in (0, 3, 15, 16, 700):
        assert h[i] == sum(int(chunk_dedup.GEAR[t[i - j]]) << j for j in range(16) if i >= j) & 0xFFFFFFFF
    for x in (b"", b"a", "é".encode() * 900, b"\0" * 1000, t):
        c = chunk_dedup.cuts(x)
        assert c[0] == 0 and c[-1] == len(x) and (np.diff(c) > 0).all() and (np.diff(c) <= chunk_dedup.MAX_CHUNK + 3).all()
        x.decode() and [x[a:b].decode() for a, b in zip(c, c[1:])]
    a, b = set(np.diff(chunk_dedup.cuts(t)).tolist()), chunk_dedup.cuts(b"an insertion " + t)
    same = {t[i:j] for i, j in zip(chunk_dedup.cuts(t), chunk_dedup.cuts(t)[1:])} & {(b"an insertion " + t)[i:j] for i, j in zip(b, b[1:])}
    assert len(same) > 0.8 * len(chunk_dedup.cuts(t)) and a


def test_runs_by_brute_force(rows):
    rng = random.Random(6)
    shared = [prose(rng, 70) for _ in range(4)]
    docs = [(i, prose(rng, 60) + "\n" + (shared[i % 4] + "\n" if i % 3 == 0 else "é ") + prose(rng, 50)) for i in range(24)]
    docs += [(30, docs[1][1]), (31, docs[2][1] + " tail"), (31, docs[2][1] + " tail"), (None, shared[0]), (40, None), (41, "")]
    d = rows(docs).repartition(4)
    distinct = sorted({(x[0] is not None, x[0] or 0, x[1]) for x in docs if x[1]}, key=lambda x: (x[0], x[1]))
    where, chunks = {}, {}
    for has, i, t in distinct:
        b = t.encode()
        c = chunk_dedup.cuts(b).tolist()
        for x, y in zip(c, c[1:]):
            where.setdefault(b[x:y], []).append((has, i, len(b[:x].decode())))
            chunks.setdefault((has, i), []).append((b[x:y], len(b[:x].decode()), len(b[:y].decode())))
    want = set()
    for (has, i), cs in chunks.items():
        run = None
        for data, x, y in [*cs, (None, 0, 0)]:
            if data is not None and len(where[data]) > 1:
                run = run or [x, y, 0]
                run[1] = y
                run[2] += (y - x) * (min(where[data]) != (has, i, x))
            else:
                if run and run[1] - run[0] >= chunk_dedup.MIN_RUN:
                    want.add((i if has else None, *run))
                run = None
    got = chunk_dedup.repeated_passages(d)
    rows_ = [(r.doc_id, r.start, r.end, r.n_removed) for r in got.collect()]
    assert set(rows_) == want and len(rows_) == len(want)
    by = {r.doc_id: r for r in chunk_dedup.passages_by_document(d).collect()}
    assert set(by) == {w[0] for w in want} and {0, 3, 6, 9, 30, 31} <= set(by)
    assert not {i for i in range(24) if i % 3} - {1, 2} & set(by)
    cut = {r.doc_id: r.text for r in chunk_dedup.without_passages(d).collect()}
    assert len(cut) == len({x[0] for x in docs}) and cut[40] is None
    assert cut[1] == docs[1][1] and cut[4] == docs[4][1]
    assert len(cut[30]) < 0.2 * len(docs[1][1])


def test_substring_odd_rows(odd, rows):
    got = chunk_dedup.passages_by_document(odd)
    assert {r.doc_id for r in got.collect()} == {5, 6}
    out = chunk_dedup.without_passages(odd)
    assert out.count() == odd.count() and out.columns == odd.columns
    assert chunk_dedup.passages_by_document(rows([])).count() == 0 and chunk_dedup.without_passages(rows([])).count() == 0
    assert out.filter(F.col("doc_id") == 5).first().text == odd.filter(F.col("doc_id") == 5).first().text
