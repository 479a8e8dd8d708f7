"""Quality scores from document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the
whole text; the normal equations of a ridge regression are summed per partition and then
per row of the matrix, so the driver sees one matrix of a fixed size.  Scores of rows that
the fit has not seen are calibrated by isotonic regression.  Only the text is an input.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "lower", "upper", "digit", "blank", "lines", "symbol", "bar", "shout", "stop", "comma",
    "other", "wide", "distinct_words", "repeated_next", "distinct_lines", "ended_lines", "short_lines",
)
FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
SEED = 20240117
THRESHOLD = 0.3
#: Steps of the score axis on which the calibration is counted; its size is all that the
#: driver gets of the labelled rows.
GRID = 2_000
#: Partitions whose sums are added up at a time.
SUMS = 64
SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>@^_~=+{}[]\\", np.uint8)


def statistics(text: str) -> list[float]:
    """Statistics of one whole text; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [""]
    m = len(lines)
    spaces = int(h[32]) + int(h[9:14].sum())
    return [
        np.log1p(len(words)), np.log1p(n), min((n - spaces) / k, 50.0),
        h[97:123].sum() / n, h[65:91].sum() / n, h[48:58].sum() / n, spaces / n, min(np.log1p(k / m), 10.0),
        h[SYMBOL_BYTES].sum() / k, h[124] / k, h[33] / k, h[46] / k, h[44] / k,
        (h[[34, 39, 40, 41, 45, 47, 58, 59, 63]].sum()) / k, h[128:].sum() / n,
        len(set(words)) / k, sum(map(eq, words, words[1:])) / k,
        len(set(lines)) / m, sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines) / m, sum(len(x) < 30 for x in lines) / m,
    ]


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Replace the text by its statistics; NULL counts as empty."""
    keep = [c for c in df.columns if c not in (text, out)]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py() or "") for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, out])

    return d.mapInArrow(tidy(run), d.drop("_text").withColumn(out, F.array().cast("array<double>")).schema)


def matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(fourier(x, self.mean, self.scale) @ self.weights, self.knots, self.levels)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """cos(w.z + b) with Gaussian w: inner products approximate the kernel of width WIDTH."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def pooled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of mean labels over ascending x: knots and levels."""
    blocks: list[list[float]] = []
    for a, s, k in zip(x, y, n):
        blocks.append([a * k, s, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(stats: DataFrame, label: str = "label", fold: str = "fold", out: str = "stats") -> Model:
    """Fit on rows (stats, label 0/1, fold 0/1); all of them are used.

    Each half is scored by the model of the other half for the calibration; the ridge
    weights come from both.  Without rows every score is 0.5.
    """
    d = stats.select(F.col(out).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f")).filter("y is not null")
    d = written(d, "quality-training")
    dim = len(STATISTICS)
    sums = d.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).orderBy("i").collect()
    if not sums:
        return Model(np.zeros(dim), np.ones(dim), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    n, s, q = (np.array([r[c] for r in sums], float) for c in ("n", "s", "q"))
    mean = s / n
    spread = np.sqrt(np.maximum(q / n - mean**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for b in batches:
            phi, y, f = fourier(matrix(b.column(0)), mean, scale), np.asarray(b.column(1)), np.asarray(b.column(2))
            for k in (0, 1):
                p = phi[f == k]
                g[k] += p.T @ np.hstack([p, y[f == k, None]])
        i, group = np.arange(2 * (FEATURES + 1)), TaskContext.get().partitionId() // SUMS
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), group)), pa.array(list(g.reshape(len(i), -1)), pa.list_(pa.float64()))], names=["i", "b", "v"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return p.head(1).assign(v=[np.sum(np.stack(p["v"]), axis=0)])

    # the sums of the partitions add up in groups first, so that no task takes those of all
    schema = "i long, b long, v array<double>"
    parts = d.mapInArrow(partial, schema).groupBy("i", "b").applyInPandas(add, schema)
    rows = parts.groupBy("i").applyInPandas(add, schema).orderBy("i").collect()
    g = np.array([r["v"] for r in rows]).reshape(2, FEATURES + 1, FEATURES + 2)

    def solve(a: np.ndarray) -> np.ndarray:
        size = max(a[-1, -2], 1.0)
        penalty = np.eye(FEATURES + 1) * RIDGE * size
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    both, other = solve(g[0] + g[1]), [solve(g[1]), solve(g[0])]

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            phi, f = fourier(matrix(b.column(0)), mean, scale), np.asarray(b.column(2))
            s = np.where(f == 0, phi @ other[0], phi @ other[1])
            at = np.clip(np.round((s + 0.5) * GRID / 2), 0, GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["at", "y"])

    grid = d.mapInArrow(unseen, "at long, y double").groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("at").collect()
    knots, levels = pooled(np.array([2 * r["at"] / GRID - 0.5 for r in grid]), np.array([r["y"] for r in grid]), np.array([float(r["n"]) for r in grid]))
    return Model(mean, scale, both, knots, levels)


def remainder(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 5


def learn(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on the labelled rows whose crc32(id) mod 5 is not 0; the halves are 1, 2 and 3, 4."""
    y = labels.select(F.col(id).alias("_id"), F.col(label).alias("label")).filter("label in (0, 1)")
    d = stats.select(F.col(id).alias("_s"), "stats").join(y, F.col("_s") == F.col("_id"))
    part = remainder(F.col("_s"))
    return fit(d.filter(part != 0).select("stats", "label", (part > 2).cast("int").alias("fold")))


def with_scores(stats: DataFrame, model: Model, out: str = "stats") -> DataFrame:
    """Replace the statistics by score (0 to 1) and predicted (1 from THRESHOLD on)."""
    keep = [c for c in stats.columns if c not in (out, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(model.scores(matrix(b.column(len(keep)))), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    d = stats.select(*[F.col(f"`{c}`") for c in keep], out)
    return d.mapInArrow(run, d.drop(out).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def score_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (id, held_out, score, predicted), one per input row.

    held_out is whether crc32 of the id as text leaves remainder 0 by 5, false for a NULL
    id.  NULL and empty texts have statistics zero and a score like any other.  Labels other
    than 0 and 1, labels of unknown ids and other columns are ignored; an id with several
    labels counts once for each.  Without labels every score is 0.5.
    """
    stats = written(with_statistics(docs.select(F.col(id), F.col(text).alias("_body")), "_body"), "quality-stats")
    scored = with_scores(stats, learn(stats, labels, id, label))
    return scored.select(id, F.coalesce(remainder(F.col(id)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be bad, all columns kept."""
    model = learn(with_statistics(docs.select(F.col(id), F.col(text).alias("_body")), "_body"), labels, id, label)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or "") for t in b.column(at)]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.scores(x) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
