"""Substring duplicates by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash is small, so the
cuts follow the content and an insertion moves only the cuts next to it.  Chunks are
compared by a 128-bit digest over all documents.  Runs of adjacent chunks that occur
elsewhere are repeated passages; the first occurrence of a chunk stays.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, written

#: A chunk ends at one place in so many, on average.
ONE_IN = 32
MIN_CHUNK, MAX_CHUNK = 16, 256
#: Bytes that the hash depends on.
WINDOW = 16
#: Shortest run of repeated chunks that counts as a passage, in characters.
MIN_RUN = 80
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at every place: sum of GEAR[b] << age, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        older = h[:-width] << np.uint32(width)
        h[width:] += older
        width *= 2
    return h


def cuts(text: bytes) -> np.ndarray:
    """Chunk borders as byte places, from 0 to the length, never inside a character."""
    n = len(text)
    if n == 0:
        return np.zeros(1, np.int64)
    data = np.frombuffer(text, np.uint8)
    places = np.flatnonzero(gear_hash(data) < np.uint32((1 << 32) // ONE_IN)) + 1
    out, last = [0], 0
    for p in places.tolist():
        if p - last < MIN_CHUNK:
            continue
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if p - last >= MIN_CHUNK:
            last = p
            out.append(p)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if last < n:
        out.append(n)
    at = np.array(out)
    inside = np.append(data & 0xC0 == 0x80, False)
    while (bad := inside[at]).any():
        at[bad] += 1
    return np.unique(at)


def chunk_table(docs: DataFrame, id: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """Rows (h1) of all chunks, or (id, key, start, end, h1, h2) if ``full``.

    ``key`` is a hash of the whole text, start and end are in characters.
    """
    d = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                at = cuts(t)
                ends = at.tolist()
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t[x:y]) for x, y in zip(ends, ends[1:])]), np.int64).reshape(-1, 2)
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0])], names=["h1"])
                    continue
                chars = np.append(0, np.cumsum(np.frombuffer(t, np.uint8) & 0xC0 != 0x80))[at].astype(np.int32)
                n = len(h)
                key = np.full(n, np.uint64(xxhash.xxh3_64_intdigest(t))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(i, n), pa.array(key), pa.array(chars[:-1]), pa.array(chars[1:]), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "key", "start", "end", "h1", "h2"])

    if not full:
        return d.mapInArrow(run, "h1 long")
    schema = d.select(F.col("_id").alias("id"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")).schema
    return d.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """Rows (id, key, start, end, n_chunks, n_removed): runs of at least ``min_run``
    characters of chunks that occur more than once in the corpus.

    The occurrence with the smallest (id, key, start) is the one that stays; n_removed counts
    the characters of the run's other chunks.  Rows equal in id and text are one document, so
    they do not remove each other's chunks.  NULL and empty texts have no chunks; a NULL id
    sorts first.  A first pass counts 64-bit halves of the digests, which combine before the
    shuffle; only chunks whose half repeats are sorted out by their whole digest.  A chunk
    that very many documents share is one group of the counts, and its rows are on the side
    of the joins that AQE splits.
    """
    halves = chunk_table(docs, id, text, full=False).groupBy("h1").count().filter("count > 1").select(F.col("h1").alias("_h"))
    halves = written(halves, "chunk-halves")
    chunks = chunk_table(docs, id, text)
    found = written(chunks.join(halves, F.col("h1") == F.col("_h"), "left_semi").distinct(), "chunk-repeats")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "start")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    first = first.select(F.col("h1").alias("_a"), F.col("h2").alias("_b"), "_first")
    d = found.join(first, (F.col("h1") == F.col("_a")) & (F.col("h2") == F.col("_b")))
    later = ~F.struct("id", "key", "start").eqNullSafe(F.col("_first"))
    d = d.select("id", "key", "start", "end", F.when(later, F.col("end") - F.col("start")).otherwise(0).alias("r"))
    order = Window.partitionBy("id", "key").orderBy("start")
    d = d.withColumn("_new", F.coalesce((F.lag("end").over(order) != F.col("start")).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy("id", "key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.sum("r").alias("n_removed"))
    return runs.filter(F.col("end") - F.col("start") >= min_run).select(F.col("id").alias(id), "key", "start", "end", "n_chunks", "n_removed")


def passages_by_document(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per document with a repeated passage: its characters in such passages, those
    to be removed, and the passages as sorted (start, end, removed) entries."""
    runs = repeated_passages(docs, id, text, min_run)
    span = F.struct("start", "end", F.col("n_removed").alias("removed"))
    return runs.groupBy(id, "key").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_repeated"), F.sum("n_removed").alias("n_removed"), F.sort_array(F.collect_list(span)).alias("passages")
    )


@apart("id", "text")
def without_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text where every chunk of the run
    has an earlier occurrence; other rows and columns are unchanged."""
    spans = passages_by_document(docs, id, text, min_run)
    gone = F.filter("passages", lambda p: p["removed"] == p["end"] - p["start"])
    spans = spans.select(F.col(id).alias("_id"), F.col("key").alias("_key"), gone.alias("_gone")).filter(F.size("_gone") > 0)
    keyed = with_key(docs, text)
    d = keyed.join(spans, F.col(f"`{id}`").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("_gone", lambda p: F.array(p["start"], p["end"]))), F.array(F.length(text)))
    d = d.withColumn("_e", F.when(F.col("_gone").isNotNull(), edges))
    kept = F.expr(f"array_join(transform(sequence(0, size(_e) div 2 - 1), i -> substring(`{text}`, _e[2 * i] + 1, _e[2 * i + 1] - _e[2 * i])), '')")
    new = F.when(F.col("_e").isNotNull(), kept).otherwise(F.col(f"`{text}`"))
    return d.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def with_key(docs: DataFrame, text: str) -> DataFrame:
    """Add _k, the hash of the whole text by which runs name their document."""
    names = docs.columns
    d = docs.select("*", F.col(f"`{text}`").cast("binary").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [None if t.as_py() is None else xxhash.xxh3_64_intdigest(t.as_py()) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([None if k is None else k - (1 << 64) if k >> 63 else k for k in keys], pa.int64())], names=[*names, "_k"])

    return d.mapInArrow(run, d.drop("_t").withColumn("_k", F.lit(None).cast("long")).schema)
