"""The audit of filter orders against brute force over all orders."""
import re
from itertools import permutations

from panelyard.llm import filter_audit
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)

SCHEMA = "doc_id long, text string, lang string"


def slow_mask(i, text, data):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)),
             i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in data)]
    return "".join(c for c, f in zip("ABCDE", fails) if f)


def slow_audit(data, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows_ = [(p or "", slow_mask(i, t, data), i) for i, t, p in data]
    out = {}
    for part in {p for p, _, _ in rows_}:
        mine, removed = [(m, i) for p, m, i in rows_ if p == part], {}
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                removed[f] = removed.get(f, 0) + len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in m for m, _ in mine) - len(gone), sum(m == f for m, _ in mine),
                                                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed[v[6]] if isinstance(v[6], str) else v[6]
    return out


def held(spark, data, labels):
    got = filter_audit.audit_documents(spark.createDataFrame(data, SCHEMA).withColumn("mask", filter_audit.F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    back = got.collect()
    assert len(back) == len({(r.part, r.filter_order, r.step) for r in back})
    assert {(r.part, r.filter_order, r.step): [*r[3:]] for r in back} == slow_audit(data, labels)


def test_every_order_by_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(220))
    loops, loud, bars = "a b c d " * 60, long.upper(), long + " | #"
    data = [(i, t, p) for i, (t, p) in enumerate([(long, "en"), (long, "de"), (loops, "en"), (loud, "en"), (bars, "de"), (bars, "en"), (loops.upper() + " $", "en"), ("", None), (None, ""), ("x", "fr"), (long + "\x0b\x1c x", "fr")])]
    data += [(None, long, "en"), (None, long, "en"), (3, loud, "en"), (20, loud, None), (21, "short", "de"), (21, "short", "de"), (22, "short", "de")]
    labels = [(0, 1, 0), (0, 1, 1), (2, 1, 1), (3, 0, 1), (6, 1, 0), (20, 1, 1), (99, 1, 1), (None, 1, 1), (21, None, 1), (22, 1, None)]
    held(spark, data, labels)


def test_empty_tables_and_one_part(spark, odd):
    held(spark, [(1, "a", "en")], [])
    assert filter_audit.audit_documents(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    got = filter_audit.document_masks(odd)
    assert got.columns == ["doc_id", "other", "kept", "mask"] and got.count() == odd.count()
    assert {r.doc_id for r in got.collect() if r["mask"] & 16} == {2, 6}


def test_many_parts(spark):
    data = [(i, "#" if i % 2 else "a", f"part{i}") for i in range(150)]
    got = filter_audit.audit_documents(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 150 * 600 and got.filter("filter_order = 'DABCE' and step = 1").groupBy().sum("removed").first()[0] == 75
