"""Equal shards by a histogram sort: exact counts, few probes, one exchange of the rows.

A row's key is 120 bits: a hash of its text, then a hash of its id and text.  In the order of
the keys the copies of a text are neighbours.  The boundary of two shards is sought on the
driver's side by counts alone: each round one grouped sum gives the exact bytes below 1 024
probes in every interval that still holds a boundary, and the interval between the two
probes around it goes on, until it is a single text.  Nothing is sampled, so a hot text or a
few very long ones cannot tilt a shard.  When all boundaries are known, every row finds its
shard by comparisons, and the rows are exchanged once.

Where a boundary lies within ``tolerance`` of a shard's bytes of an end of the text it falls
into, it is moved to that end and the text's copies stay together; otherwise it goes between
two of the copies.  So the result is defined by the rows alone, not by the probes.
"""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written

#: Bits of one hash, and of one round of probes.
WORD, ROUND = 60, 10
#: Bytes of text of one task after the exchange.
PIECE_BYTES = 32 << 20

Key = tuple[int, int]


def _word(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, WORD // 4), 16, 10).cast("long")


def text_word(text: Column) -> Column:
    return _word(F.coalesce(text, F.lit("")))


def row_word(id: Column, text: Column) -> Column:
    return _word(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL: none) and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _nearest(at: Fraction, left: int, right: int) -> tuple[Fraction, bool]:
    """Distance to the nearer end, and whether that is the left one (also if equal)."""
    return min(at - left, right - at), at - left <= right - at


def splitters(rows: DataFrame, shards: int, tolerance: Fraction = Fraction(1, 1000)) -> list[Key]:
    """Keys at which shards 1, 2, ... begin; rows has columns (h, s, size), read once a round.

    The driver holds at most 1 024 counts per boundary and round; a word takes at most six
    rounds, and one round divides the open intervals a thousandfold.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    out: dict[int, Key] = {}
    # An open boundary knows the interval it is in: word (a text, or None for all), the depth
    # and the prefix of the bits tried so far, and the exact bytes before the interval.
    todo = {k: (None, 0, 0, 0) for k in range(1, shards)}
    while todo and total:
        spans = sorted({v for v in todo.values()}, key=repr)
        cell = None
        for i, (word, depth, prefix, _) in enumerate(spans):
            c = F.col("h" if word is None else "s")
            inside = F.shiftright(c, WORD - depth) == prefix if word is None else (F.col("h") == word) & (F.shiftright(c, WORD - depth) == prefix)
            value = F.struct(F.lit(i).alias("i"), F.shiftright(c, WORD - depth - ROUND).alias("c"))
            cell = F.when(inside, value) if cell is None else cell.when(inside, value)
        found = rows.withColumn("cell", cell).filter("cell is not null").groupBy("cell").agg(
            F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("s").alias("s0"), F.max("s").alias("s1"))
        cells: dict[int, list] = {i: [] for i in range(len(spans))}
        for r in found.select("cell.i", "cell.c", "size", "h0", "h1", "s0", "s1").collect():
            cells[r.i].append(r)
        left = {}
        for k, span in todo.items():
            word, depth, _, before = span
            at = Fraction(k * total, shards)
            for r in sorted(cells[spans.index(span)], key=lambda r: r.c):
                if before + r["size"] > at:
                    break
                before += r["size"]
            miss, first = _nearest(at, before, before + r["size"])
            if word is None and r.h0 == r.h1:
                if miss <= tolerance * Fraction(total, shards) or r.s0 == r.s1:
                    out[k] = (r.h0, 0) if first else (r.h0 + 1, 0)
                else:
                    left[k] = (r.h0, 0, 0, before)
            elif word is not None and r.s0 == r.s1:
                out[k] = (word, r.s0) if first else (word, r.s0 + 1)
            else:
                left[k] = (word, depth + ROUND, r.c, before)
        todo = left
    return [out.get(k, (0, 0)) for k in range(1, shards)]


def _shard(h: Column, s: Column, cuts: list[Key], low: int = 0) -> Column:
    """Number of cuts at or below the key, by halving."""
    if not cuts:
        return F.lit(low)
    m = len(cuts) // 2
    ch, cs = cuts[m]
    below = (h < ch) | ((h == ch) & (s < cs))
    return F.when(below, _shard(h, s, cuts[:m], low)).otherwise(_shard(h, s, cuts[m + 1 :], low + m + 1))


def place(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text", tolerance: Fraction = Fraction(1, 1000), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with size (long), shard (int) and slot (long).

    The sizes of the shards differ from their mean by ``tolerance`` or the row that lies on
    the boundary.  slot numbers the rows of a shard from 0 without gaps, in the order of a
    hash of id and text, so that copies are scattered within a shard.  NULL text is an empty
    text of size 1, a NULL id an id like others.  Rows that agree in id and text share one key
    and so one shard, in any order.  With fewer rows than shards some shards are empty; an
    empty table gives no rows.  Columns of ``docs`` named size, shard or slot are replaced.
    """
    docs = docs.drop("size", "shard", "slot")
    h, s, piece, at, before = free_names(docs, "h", "s", "piece", "at", "before")
    keyed = docs.withColumn("size", size_of(F.col(f"`{text}`"))).withColumn(h, text_word(F.col(f"`{text}`"))).withColumn(s, row_word(F.col(f"`{id}`"), F.col(f"`{text}`")))
    rows = written(keyed.select(F.col(h).alias("h"), F.col(s).alias("s"), "size"), "shard-keys")
    cuts = splitters(rows, shards, tolerance)
    mean = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    # Tasks after the exchange: pieces of a shard by the leading bits of the row's hash.
    bits = max(0, int(mean // piece_bytes).bit_length())

    def placed(d: DataFrame, a: str, b: str) -> DataFrame:
        return d.withColumn("shard", _shard(F.col(a), F.col(b), cuts)).withColumn(piece, F.shiftright(b, WORD - bits))

    counts = placed(rows, "h", "s").groupBy("shard", piece).count()
    run = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("shard", piece, F.coalesce(F.sum("count").over(run), F.lit(0)).alias(before)), "shard-offsets")
    within = Window.partitionBy("shard", piece).orderBy(s, h)
    out = placed(keyed, h, s).withColumn(at, F.row_number().over(within)).join(offsets, ["shard", piece])
    return out.withColumn("slot", F.col(before) + F.col(at) - 1).select(*[f"`{c}`" for c in docs.columns], "size", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 8, **how) -> None:
    """Write every shard into a folder of its own, ``shard=0`` and on, with all columns."""
    place(docs, shards, **how).write.partitionBy("shard").parquet(folder)
