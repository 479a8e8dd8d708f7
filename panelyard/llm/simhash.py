"""SimHash near-duplicates with pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks.  Two fingerprints that differ in at most three
bits agree in at least three whole blocks, so each of the twenty triples of blocks is a key,
and every close pair meets under one of them.  Fingerprints are made distinct first: a group
of exact copies, however large, is one row.  Under a key the members are compared by XOR
and bit count, and only the edges of a spanning forest leave the comparison, so that a dense
group of near copies costs no quadratic output.  A key with more than ``GROUP`` different
fingerprints is not compared in one task; there every member is spread over the masks of
three of its remaining bits, under which at most eight fingerprints can meet.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, components, first_of_each, text_key, written

SEED = 42
BITS = 64
MAX_DISTANCE = 3
BLOCKS = 6
GROUP = 16_384
#: Shingles whose bits are counted at once; bounds the memory of one very long text.
STEP = 65_536


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of one UTF-8 text: majority bits of the XXH64 of its word shingles."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())
    h = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), STEP):
        part = np.unpackbits(h[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """Replace the text by its fingerprint as a signed long; the other columns pass through.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  NULL counts as no words: zero.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in b.column(len(keep))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps.view(np.int64))], names=[*keep, out])

    schema = d.drop("_text").withColumn(out, F.lit(0).cast("long")).schema
    return d.mapInArrow(run, schema)


def block_masks(blocks: int = BLOCKS, distance: int = MAX_DISTANCE) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks."""
    at = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [((1 << at[i + 1]) - 1) ^ ((1 << at[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs within ``distance`` bits.

    Breadth first: each member reached takes all unreached close members with it, one vector
    comparison per member.
    """
    left, out = fps.astype(np.int64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def close_edges(fps: DataFrame, fp: str = "fp", distance: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``distance`` bits.

    Not every close pair is an edge, but each is joined by a path of edges whose ends are
    close.  ``group`` bounds the work of one task, not the result.
    """
    masks = block_masks(distance=distance)
    keyed = fps.select(F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"), F.col(fp).alias("fp"))
    sizes = keyed.groupBy("t", "k").count().filter("count > 1")
    sizes = written(sizes, "simhash-keys")
    hot = sizes.filter(F.col("count") > group).select("t", "k")
    cool = keyed.join(sizes.filter(F.col("count") <= group).select("t", "k"), ["t", "k"], "left_semi")
    lists = cool.groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, edges = b.column(0), []
            values, at = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy() - col.offsets[0].as_py()
            for i in range(len(at) - 1):
                edges += forest(values[at[i] : at[i + 1]], distance)
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleared = {}
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t not in cleared:
                    free = [i for i in range(BITS) if not masks[t] >> i & 1]
                    cleared[t] = np.array([sum(1 << i for i in c) for c in combinations(free, distance)], np.uint64).view(np.int64)
                m = cleared[t]
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(x & ~m), pa.array(np.full(len(m), x))], names=["m", "r", "fp"])

    near = lists.mapInArrow(compare, "a long, b long")
    wide = keyed.join(hot, ["t", "k"], "left_semi").select("t", "fp").mapInArrow(spread, "m long, r long, fp long")
    few = wide.groupBy("m", "r").agg(F.collect_set("fp").alias("s")).filter(F.size("s") > 1)
    far = few.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a <> b")
    return near.unionByName(far)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, distance: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """One row (id, fp, component_id) per input row.

    component_id is the smallest id that can be reached over links of fingerprints at most
    ``distance`` bits apart, the row's own included.  Texts without words, empty and NULL
    texts share fingerprint zero.  Rows with a NULL id keep a NULL id and take part; a
    component of NULL ids alone has a NULL component_id.  Repeated rows stay repeated; an
    empty table gives no rows; other columns are not read.
    """
    marked = written(with_fingerprint(df.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text", words), "simhash-fp")
    distinct = written(marked.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-distinct")
    roots = components(close_edges(distinct.select("fp"), "fp", distance, group))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("_low"))
    moved = linked.join(lows, "root").select(F.col("fp").alias("_fp"), "_low")
    labels = distinct.join(moved, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNotNull(), F.col("_low")).otherwise(F.col("low")).alias("component_id"))
    return marked.join(labels, "fp").select(F.col("_id").alias(id), "fp", "component_id")


@apart("id", "text")
def keep_first(df: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component, with all its columns: see ``common.first_of_each``."""
    texts = df.select(text_key(text).alias("_key"), F.col(f"`{text}`").alias("_text"))
    labels = near_duplicates(texts, "_key", "_text", **how).select("_key", "component_id").distinct()
    return first_of_each(df, labels, id, text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
