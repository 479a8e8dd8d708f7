"""Ranked search against scores of all documents by the plain formula."""
import math
import random
import re
from collections import Counter

import pytest

from panelyard.llm import lexical_search as ls
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranks(docs, items, k=10):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(c for *_, c in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(slow_terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(docs, items, **how):
    got = ls.rank_documents(docs, items, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Élan", "É2", "x-y", "UPPER"]
    def text():
        return " ".join(words[min(int(rng.paretovariate(0.5)), len(words)) - 1] for _ in range(rng.choice([1, 3, 20, 90])))
    hot = "the same old text of w1 w2 w3"
    docs = [(i, hot if rng.random() < 0.33 else text()) for i in range(n)]
    return docs, [(j, text()) for j in range(12)] + [(50, hot), (51, "no such thing"), (52, ""), (53, None), (50, hot + " w4")]


@pytest.mark.parametrize("bucket, first", [(1 << 17, 2), (200, 1), (1, 3)])
def test_all_scores_by_the_formula(rows, bucket, first):
    docs, items = corpus(4)
    d = rows(docs).repartition(5)
    assert ranked(d, rows(items, "item_id long, text string"), bucket=bucket, first=first) == slow_ranks(docs, items)


def test_bounds_leave_buckets_out_and_lose_nothing(rows):
    docs = [(i, "common " + ("rare " * 3 if i < 12 else f"other{i} " * (1 + i % 40))) for i in range(400)]
    items = [(1, "rare common")]
    asked = ls.item_terms(rows(items, "item_id long, text string"))
    index = ls.build_index(rows(docs), wanted=asked, bucket=40)
    buckets = index.postings.select("bucket").distinct().count()
    visited = []
    whole = ls._score

    def seen(visits, *rest):
        visited.append(visits.count())
        return whole(visits, *rest)

    ls._score = seen
    try:
        got = [(r.rank, r.id) for r in ls.search(index, asked, first=1).orderBy("rank").collect()]
    finally:
        ls._score = whole
    assert got == [(r, i) for _, r, i, _ in sorted(slow_ranks(docs, items), key=lambda x: x[1])]
    assert sum(visited) < buckets


def test_index_of_all_terms_holds_every_posting(rows):
    docs, _ = corpus(9, 120)
    index = ls.build_index(rows(docs), bucket=100)
    got = {(d["uid"], r.term.decode()): r.tf for r in index.postings.collect() for d in r.docs}
    assert sorted((t, c) for (_, t), c in got.items()) == sorted((t, c) for _, x in docs for t, c in Counter(slow_terms(x)).items())
    assert index.documents == 120 and index.length == sum(len(slow_terms(x)) for _, x in docs)
    sizes = Counter()
    for r in index.postings.collect():
        sizes[r.bucket] += len(r.docs)
    assert max(sizes.values()) < 300 and len({(r.bucket, r.m, r.term, r.tf) for r in index.postings.collect()}) == index.postings.count()


def test_odd_tables(rows, odd):
    items = [(1, "one no id here"), (2, "b h"), (3, "ünïcödé ﬁ"), (None, "one")]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert ranked(odd, rows(items, "item_id long, text string")) == slow_ranks(docs, items)
    assert ranked(rows([]), rows(items, "item_id long, text string")) == []
    assert ranked(odd, rows([], "item_id long, text string")) == []
