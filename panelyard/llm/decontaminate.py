"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

An item of m characters may occur with k edits.  Cut into k + 1 pieces, at least one piece
of every such occurrence is untouched.  All pieces form one Aho-Corasick automaton, which
reads each document once; where a piece is found, the item is aligned around it and its
smallest edit distance to any substring is computed bit-parallel, all rows of the item in one
integer.  Tasks read the items from the shared folder, so none pass through the driver.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import tidy, work_folder, written

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Characters of items that one automaton holds; more are searched in several passes.
BLOCK_CHARS = 8 << 20
SPACE = re.compile("[\t-\r ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text: str) -> str:
    """A-Z in lower case, runs of white space as one space, trimmed."""
    return SPACE.sub(" ", text.translate(LOWER)).strip(" ")


def best_match(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to a substring of the text, up to ``limit``,
    and the end of the first substring that has it (Myers 1999)."""
    m = len(pattern)
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = bits.get(c, 0)
        x = eq | down
        d = ((eq & up) + up ^ up) | eq | down
        h_up, h_down = down | ~(d | up) & full, up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up, h_down = h_up << 1 & full, h_down << 1 & full
        up, down = h_down | ~(x | h_up) & full, h_up & x
        if score <= limit:
            best, limit = (score, j + 1), score - 1
            if score == 0:
                break
    return best


class Searcher:
    """Finds items, given as (id, text), in documents."""

    def __init__(self, items: list[tuple[object, str]], chars_per_edit: int):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for id, text in items:
            t = plain(text)
            if not t:
                continue
            k = len(t) // chars_per_edit
            n = len(self.items)
            self.items.append((id, t, k))
            cuts = [round(i * len(t) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.machine = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.machine.add_word(p, (len(p), at))
        if pieces:
            self.machine.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item found; places
        are in the plain form of the text, the start is the end less the item's length."""
        if not self.items:
            return []
        t = plain(text)
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (size, at) in self.machine.iter(t):
            for n, offset in at:
                if n in found and found[n][0] == 0:
                    continue
                _, item, k = self.items[n]
                begin = end + 1 - size - offset
                a, b = max(0, begin - k), min(len(t), begin + len(item) + k)
                seen = tried.setdefault(n, [])
                if seen and seen[-1][0] <= a and b <= seen[-1][1]:
                    continue
                if t.startswith(item, max(begin, 0)) and begin >= 0:
                    found[n] = (0, begin + len(item))
                    continue
                # Neighbouring hits of one occurrence share a wider window.
                a, b = max(0, a - k), min(len(t), b + k)
                seen.append((a, b))
                hit = best_match(item, t[a:b], k)
                if hit and (n not in found or hit[0] < found[n][0]):
                    found[n] = (hit[0], a + hit[1])
        return [(self.items[n][0], d, max(0, e - len(self.items[n][1])), e) for n, (d, e) in sorted(found.items())]


def item_blocks(items: DataFrame, id: str, text: str, block_chars: int) -> list[str]:
    """Write the items to the shared folder, about ``block_chars`` characters in a folder each."""
    rows = items.filter(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    blocks = -(-(rows.agg(F.sum(F.length("_text"))).first()[0] or 0) // block_chars)
    folder = work_folder(items.sparkSession, "items")
    if blocks:
        rows.withColumn("_block", F.pmod(F.xxhash64("_text"), F.lit(blocks))).write.partitionBy("_block").parquet(folder)
    return [f"{folder}/_block={i}" for i in range(blocks)]


def read_block(folder: str) -> list[tuple[object, str]]:
    """The items (id, text) of a block; none if no item fell to it."""
    files, path = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    out = []
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with files.open_input_file(name) as f:
            t = pq.ParquetFile(f).read(["_id", "_text"])
            out += zip(t.column("_id").to_pylist(), t.column("_text").to_pylist())
    return out


def find_items(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, item_id, distance, start, end) for every document and item that it holds.

    An item of m characters occurs where some substring is within m // ``chars_per_edit``
    edits of it, both in plain form; the row tells the best such place.  Items are searched in
    blocks of about ``block_chars`` characters, each of which passes over the documents
    once; the rows of several blocks are written, pass by pass.  NULL and blank items occur nowhere; NULL and empty texts hold nothing; repeated
    documents and repeated items give repeated rows; a NULL id stays NULL.  Other columns
    are not read.
    """
    d = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    types = {f.name: f.dataType for f in d.schema} | {"item": items.schema[item_id].dataType}
    empty = docs.sparkSession.createDataFrame([], "distance int, start int, end int")
    schema = empty.select(F.lit(None).cast(types["_id"]).alias(id), F.lit(None).cast(types["item"]).alias(item_id), "*").schema
    item_type = to_arrow_type(types["item"])
    out, blocks = docs.sparkSession.createDataFrame([], schema), item_blocks(items, item_id, item_text, block_chars)
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block: str = block) -> Iterator[pa.RecordBatch]:
            s = Searcher(read_block(block), chars_per_edit)
            for b in batches:
                rows = [(i.as_py(), *hit) for i, t in zip(b.column(0), b.column(1)) for hit in s.search(t.as_py() or "")]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], item_type), *(pa.array(c, pa.int32()) for c in cols[2:])], names=[id, item_id, "distance", "start", "end"])

        hits = d.mapInArrow(tidy(run), schema)
        if len(blocks) == 1:
            return hits
        out = out.unionByName(written(hits, "items-found"))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept, in one pass per block."""
    out, at, blocks = docs, docs.columns.index(text), item_blocks(items, item_text, item_text, block_chars)
    for n, block in enumerate(blocks, 1):

        def run(batches: Iterator[pa.RecordBatch], block: str = block) -> Iterator[pa.RecordBatch]:
            s = Searcher(read_block(block), chars_per_edit)
            for b in batches:
                yield b.filter(pa.array([not s.search(t.as_py() or "") for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(tidy(run), docs.schema)
        if n < len(blocks):
            out = written(out, "items-dropped")
    return out
