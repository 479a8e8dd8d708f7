"""Ranked lexical search over a length-stratified index, exact top documents for every item.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; only
A-Z are lower-cased.  The documents of one length normaliser m are a stratum.  The strata are
laid end to end and cut into buckets of about ``BUCKET`` postings, so that a bucket is a run
of small strata or a part of a large one.  The index has one row per bucket, m, term and tf with
the documents of that posting list, so an impact is computed once per m and tf, not per
document.  The impacts of the largest tf of each term bound what a bucket can give to an item.

An item first visits the buckets of its highest bounds.  The score of its k-th best document
there is a threshold, and of the other buckets only those whose bound reaches it are visited.
Nothing else is skipped, so the result is that of scoring all documents.  Items and buckets
meet in cogroups of one bucket: no item or posting passes through the driver.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Postings of a bucket; bounds the work of one task, not the result.
BUCKET = 1 << 17
#: Buckets that an item visits for its threshold.
FIRST = 2
#: Scores that a task holds at once.
CELLS = 4_000_000
#: Bits of the filter of query terms: its size does not depend on the number of items.
FILTER_BITS = 20

_LETTERS = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Bytes of UTF-8 to bytes of terms: separators are spaces, A-Z are lower-cased.
_TABLE = bytes(c if c in _LETTERS else 0x20 for c in range(0x100)).translate(bytes(range(0x41)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x5B, 0x100)))


class Index(NamedTuple):
    """postings: (bucket, m, term, tf, docs); terms: (term, df); documents: N; length: L."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    length: int


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _counted(df: DataFrame, keep: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """Rows (keep..., n, term, tf) of a text column ``text``, which comes last in ``df``.

    A text with terms also has one row with the empty term.  ``bits`` drops terms that no
    item can hold; what passes by chance falls out of the later joins.
    """
    mask = (1 << FILTER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                at, ns, ends, words, counts = [], [], [0], [], []
                for i, t in enumerate(part.column(len(keep))):
                    found = terms_of(t.as_py() or b"")
                    if not found:
                        continue
                    times = Counter(found)
                    if bits is not None:
                        times = {w: c for w, c in times.items() if bits[zlib.crc32(w) & mask]}
                    words.append(b"")
                    counts.append(1)
                    words += times.keys()
                    counts += times.values()
                    at.append(i)
                    ns.append(len(found))
                    ends.append(len(words))
                ids = part.take(pa.array(at, pa.int64())).columns[: len(keep)]
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(ns, pa.int64()), *lists], names=[*keep, "n", "terms", "tfs"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    lists = df.mapInArrow(run, f"{schema}, n long, terms array<binary>, tfs array<long>")
    pairs = lists.select(*keep, "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return pairs.select(*keep, "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item, item_id, term), each term once; every row of ``items`` is an item of its own."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id}`").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return written(_counted(numbered, ["item", "item_id"]).filter("term <> X''").select("item", "item_id", "term"), "search-items")


def _lists(bucket: pa.Table) -> pa.Table:
    """Posting lists (bucket, m, term, tf, docs) of the postings of one bucket."""
    b = bucket.combine_chunks()
    words = b.column("term").chunk(0).dictionary_encode()
    keys = [b.column("m").to_numpy(), words.indices.to_numpy(), b.column("tf").to_numpy()]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    starts = np.flatnonzero(new)
    rows = pa.array(order)
    docs = pa.StructArray.from_arrays([b.column(c).chunk(0).take(rows) for c in ("id", "uid")], names=["id", "uid"])
    docs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), docs)
    heads = b.select(["bucket", "m", "term", "tf"]).take(pa.array(order[starts]))
    return heads.append_column("docs", docs)


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", wanted: DataFrame | None = None, bucket: int = BUCKET) -> Index:
    """The index of all rows of ``docs``; ``wanted`` (rows with a column term) limits its terms.

    Numbers and lengths always count all rows with a term and all their terms.
    """
    bits = None
    if wanted is not None:
        bits = np.zeros(1 << FILTER_BITS, bool)
        place = F.crc32("term").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        bits[[r[0] for r in wanted.select(place).distinct().collect()]] = True
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    pairs = written(_counted(rows, ["uid", "id"], bits), "search-pairs")
    lengths = pairs.filter("term = X''")
    n, total = (v or 0 for v in lengths.agg(F.count("*"), F.sum("n")).first())
    pairs = pairs.filter("term <> X''")
    if wanted is not None:
        pairs = pairs.join(wanted.select("term").distinct(), "term", "left_semi")
    m = F.expr(f"10L + ((90L * n * {n}L) div {max(total, 1)}L)")
    # One row per stratum: their number is bounded by that of different text lengths.
    strata = pairs.groupBy(m.alias("m")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strata = written(strata.select("m", "rows", before.alias("before")), "search-strata")
    # All postings of a document go to one place of its stratum.
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("uid"), "rows")) / bucket).cast("long")
    placed = pairs.withColumn("m", m).join(strata, "m").select(at.alias("bucket"), "m", "term", "tf", "id", "uid")
    id_type = placed.schema["id"].dataType.simpleString()
    lists = placed.groupBy("bucket").applyInArrow(_lists, f"bucket long, m long, term binary, tf long, docs array<struct<id:{id_type},uid:long>>")
    postings = written(lists, "search-index")
    terms = postings.groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("df"))
    return Index(postings, written(terms, "search-terms"), n, total)


def impact(tf, m):
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def best(score: np.ndarray, ids: np.ndarray, none: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; equal ones by id, rows without id last."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((uids[at], ids[at], none[at], -score[at]))][:k]


def _score(visits: DataFrame, postings: DataFrame, id_type: str, k: int) -> DataFrame:
    """The k best documents (item, id, uid, score) of every visit (bucket, item, terms)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"item": [], "id": [], "uid": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            lists = left.column("docs").chunk(0)
            docs = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            uid, first, local = np.unique(docs.field("uid").to_numpy(), return_index=True, return_inverse=True)
            id_ = docs.field("id").take(pa.array(first))
            none, ids = id_.is_null().to_numpy(zero_copy_only=False), id_.fill_null(0).to_numpy()
            tf, m = left.column("tf").to_numpy(), left.column("m").to_numpy()
            row_impact = impact(tf, m)
            terms = left.column("term").combine_chunks().dictionary_encode()
            order = np.argsort(terms.indices.to_numpy(), kind="stable")
            starts = np.concatenate([[0], np.cumsum(size)])
            lists_of: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            words = terms.dictionary.to_pylist()
            cuts = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(words) + 1))
            for t, w in enumerate(words):
                rows = order[cuts[t] : cuts[t + 1]]
                lists_of[w] = (np.concatenate([local[starts[r] : starts[r + 1]] for r in rows]), np.repeat(row_impact[rows], size[rows]))
            items, asked = right.column("item").to_pylist(), right.column("terms").to_pylist()
            step = max(1, CELLS // len(uid))
            for i in range(0, len(items), step):
                holders: dict[bytes, list[int]] = {}
                weight: dict[bytes, int] = {}
                for j, ts in enumerate(asked[i : i + step]):
                    for t in ts:
                        if t["term"] in lists_of:
                            holders.setdefault(t["term"], []).append(j)
                            weight[t["term"]] = t["w"]
                scores = np.zeros((min(step, len(items) - i), len(uid)), np.int64)
                for t, who in holders.items():
                    at, value = lists_of[t]
                    scores[np.ix_(who, at)] += weight[t] * value
                for j, s in enumerate(scores):
                    top = best(s, ids, none, uid, k)
                    out["item"] += [items[i + j]] * len(top)
                    out["id"] += [None if none[p] else int(ids[p]) for p in top]
                    out["uid"] += uid[top].tolist()
                    out["score"] += s[top].tolist()
        return pa.table({"item": pa.array(out["item"], pa.int64()), "id": pa.array(out["id"], id_.type if out["id"] else pa.int64()),
                         "uid": pa.array(out["uid"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    visited = postings.join(visits.select("bucket").distinct(), "bucket", "left_semi")
    return visited.groupBy("bucket").cogroup(visits.groupBy("bucket")).applyInArrow(run, f"item long, id {id_type}, uid long, score long")


def search(index: Index, items: DataFrame, k: int = 10, first: int = FIRST) -> DataFrame:
    """Rows (item, id, uid, score, rank): the k best documents of every item.

    items: rows of ``item_terms``.  Documents that share no term with an item are not found
    for it; an item without known terms has no rows.
    """
    n = index.documents
    w = F.floor(1000 * F.log((F.lit(2 * n + 2)).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighted = written(items.join(index.terms, "term").select("item", "term", w.alias("w")), "search-weights")
    lists = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    most = F.max(F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)"))
    reach = index.postings.groupBy("bucket", "term").agg(most.alias("most")).join(weighted, "term")
    bounds = written(reach.groupBy("item", "bucket").agg(F.sum(F.col("w") * F.col("most")).alias("bound")).filter("bound > 0"), "search-bounds")
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "bucket"))
    opening = written(bounds.withColumn("turn", turn).filter(F.col("turn") <= first).drop("turn"), "search-opening")
    id_type = index.postings.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    start = written(_score(opening.join(lists, "item").select("bucket", "item", "terms"), index.postings, id_type, k), "search-start")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid"))
    least = start.withColumn("rank", rank).filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
    rest = bounds.join(opening.select("item", "bucket"), ["item", "bucket"], "left_anti").join(least, "item", "left").filter("least is null or bound >= least")
    more = _score(rest.join(lists, "item").select("bucket", "item", "terms"), index.postings, id_type, k)
    return start.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", bucket: int = BUCKET, first: int = FIRST) -> DataFrame:
    """Rows (item id, rank, document id, score) of the k best documents with a score above 0.

    Equal scores are ranked by ascending id, NULL ids last.  NULL and empty texts have no
    terms: such documents are not found and not counted, such items have no rows.  Repeated
    documents each take a rank, repeated items each have their rows.  Other columns are not
    read; an empty table on either side gives no rows.  Document ids are whole numbers.
    """
    asked = item_terms(items, item_id, item_text)
    index = build_index(docs, id, text, asked, bucket)
    names = asked.select("item", F.col("item_id").alias("_item_id")).distinct()
    found = search(index, asked, k, first).join(names, "item")
    return found.select(F.col("_item_id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
