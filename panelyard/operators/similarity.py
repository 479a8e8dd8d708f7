"""Pairs of entities by similarity, without emitting all pairs.

All-pairs quantities (cosine, lead-lag correlation) are computed block against block: rows
are hashed into blocks of bounded size, every unordered pair of blocks is one task doing dense
matrix products, and only the pairs that count (top k, above a threshold) leave a task.  The
top k by cosine writes its blocks once and reads those that angles to a few pivots leave.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import clean, clip
from ..functions.ranks import average_ranks
from ..session import checkpoint_folder, settle

BLOCK_ROWS = 2048


def block_pairs(
    df: DataFrame, key: str, within: Sequence[str], fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """fn(left block, right block) for every ordered pair of blocks of each ``within`` group.

    Only the keys are counted to size the blocks; a block holds about ``block_rows`` rows of
    one group, so no task grows with the data.  An unordered pair of blocks meets once, in
    one task, for both directions.
    """
    sizes = df.groupBy(*within).count() if within else df.agg(F.count("*").alias("count"))
    sizes = sizes.withColumn("_nb", F.ceil(F.col("count") / block_rows).cast("long")).drop("count")
    d = df.join(sizes, list(within)) if within else df.join(sizes)
    d = d.withColumn("_b", F.pmod(F.xxhash64(key), F.greatest(F.col("_nb"), F.lit(1))))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    u = d.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o", "_nb")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["_b"] == pdf["_i"]
        one = pdf[first].reset_index(drop=True)
        if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
            return fn(one, one)
        other = pdf[~first].reset_index(drop=True)
        return pd.concat([fn(one, other), fn(other, one)])

    return u.groupBy(*within, "_i", "_j").applyInPandas(run, schema)


def top_per_focal(df: DataFrame, k: int, by: Sequence[str] = ("focal",), score: str = "sim", tie: str = "neighbor") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


#: Pivots of ``top_k_cosine``, whatever the number of rows: they travel with every task.
PIVOTS = 256
#: Blocks of focal rows that one task of ``top_k_cosine`` holds.
HELD = 4


def top_k_cosine(df: DataFrame, key: str, vector: str, k: int = 5, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """k most similar other rows per row by cosine, positive similarities only; exact.

    Rows gather around the nearest of at most ``pivots`` rows, and blocks of such a cluster
    know their largest angle from its pivot.  Each block is written once to the shared folder.
    A task holds some blocks of focal rows and reads the others one after another, nearest
    first; by the triangle inequality of angles a block is of use to a row only if the row's
    angle to the pivot less the block's radius allows its k-th score so far, and blocks of use
    to no row are not read.  So rows move a fixed number of times, however many blocks they
    meet; only products and reads grow with the square where the angles rule nothing out.
    Rows that are NULL, empty or zero are similar to none; vectors must have one length.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"focal {kind}, neighbor {kind}, sim double"
    d = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    d = settle(d.filter(F.exists("v", lambda x: x != 0)))
    n = d.count()
    if not n:
        return spark.createDataFrame([], schema + ", rank long")
    m = min(pivots, -(-n // block_rows))
    heads = _unit(np.array([r.v for r in d.orderBy(F.xxhash64("key"), "key").limit(m).collect()]))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = np.clip(_unit(np.stack(pdf["v"].to_numpy())) @ heads.T, -1, 1)
            at = c.argmax(axis=1)
            yield pdf.assign(c=at.astype(np.int64), a=np.arccos(c[np.arange(len(c)), at]))

    near = d.mapInPandas(gather, f"key {kind}, v array<double>, c long, a double")
    # One row per pivot: the parts of its cluster and their common radius.
    clusters = settle(near.groupBy("c").agg(F.ceil(F.count("*") / block_rows).alias("parts"), F.max("a").alias("r")))
    radius = np.full(m, np.inf)
    for r in clusters.collect():
        radius[r.c] = r.r
    placed = settle(near.join(clusters.drop("r"), "c").withColumn("b", F.pmod(F.xxhash64("key"), "parts")).select("key", "v", "c", "b"))
    folder = f"{checkpoint_folder(spark)}/cosine-{uuid.uuid4().hex}"

    def store(group: pa.Table) -> pa.Table:
        # Each attempt writes a file of its own; only those of finished tasks are listed.
        t = group.sort_by("key").combine_chunks()
        x = _unit(t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(t), heads.shape[1]))
        block = pa.table({"key": t.column("key"), "v": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])})
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, block.schema) as f:
            f.write_table(block)
        return pa.table({"c": t.column("c")[:1], "b": t.column("b")[:1], "name": pa.array([name])})

    # One name per block goes through the driver, no row.
    listed = placed.groupBy("c", "b").applyInArrow(store, "c long, b long, name string").collect()
    blocks = [(r.c, r.name) for r in sorted(listed)]
    tasks = max(-(-n // (HELD * block_rows)), min(len(blocks), 4 * spark.sparkContext.defaultParallelism))
    cuts = [len(blocks) * i // tasks for i in range(tasks + 1)]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)

        def read(name: str) -> pa.Table:
            with files.open_input_file(f"{base}/{name}") as f:
                return pa.ipc.open_file(f).read_all().combine_chunks()

        for b in batches:
            for i in b.column(0).to_pylist():
                yield from _nearest(blocks[cuts[i] : cuts[i + 1]], blocks, read, heads, radius, k, block_rows).to_batches()

    return top_per_focal(spark.range(0, tasks, 1, tasks).mapInArrow(visit, schema), k)


def _nearest(
    own: list[tuple[int, str]], blocks: list[tuple[int, str]], read: Callable[[str], pa.Table], heads: np.ndarray, radius: np.ndarray, k: int, tile: int
) -> pa.Table:
    """Rows (focal, neighbor, sim): the k best of all ``blocks`` for each row of the blocks ``own``.

    Blocks are (cluster, name); ``read`` gives a block's keys, in order, and unit vectors.
    """
    mine = pa.concat_tables([read(name) for _, name in own]).combine_chunks()
    names, x = mine.column("key"), _matrix(mine)
    named = np.flatnonzero(names.is_valid().to_numpy())
    mine_named = names.drop_null().to_numpy()
    # The best similarity that a cluster can have to a row.
    bound = np.cos(np.clip(np.arccos(np.clip(x @ heads.T, -1, 1)) - radius, 0, np.pi))
    home, most = {name for _, name in own}, bound.max(axis=0)
    best = pa.table({"i": pa.array([], pa.int64()), "neighbor": pa.array([], names.type), "sim": pa.array([], pa.float64())})
    least = np.zeros(len(x))
    for c, name in sorted(blocks, key=lambda b: (b[1] not in home, -most[b[0]])):
        rows = np.flatnonzero(bound[:, c] >= least - 1e-9)
        if not len(rows):
            continue
        block = read(name)
        others, y = block.column("key"), _matrix(block)
        # Keys are in order, NULL last, so those equal to a row's are one stretch.
        theirs = others.drop_null().to_numpy()
        first, last = np.zeros((2, len(x)), np.int64)
        first[named], last[named] = np.searchsorted(theirs, mine_named, "left"), np.searchsorted(theirs, mine_named, "right")
        found = [best]
        for s in range(0, len(rows), tile):
            part = rows[s : s + tile]
            sim = x[part] @ y.T
            for r in np.flatnonzero(first[part] < last[part]):
                sim[r, first[part[r]] : last[part[r]]] = -np.inf
            i, j = _at_least(sim, least[part], k)
            found.append(pa.table({"i": part[i], "neighbor": others.take(pa.array(j)), "sim": sim[i, j]}))
        if sum(map(len, found)) == len(best):
            continue
        best = pa.concat_tables(found).sort_by([("i", "ascending"), ("sim", "descending"), ("neighbor", "ascending")])
        i = best.column("i").to_numpy()
        best = best.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < k)).combine_chunks()
        i, sims = best.column("i").to_numpy(), best.column("sim").to_numpy()
        full = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
        least[i[full]] = sims[full]
    return pa.table({"focal": names.take(best.column("i")), "neighbor": best.column("neighbor"), "sim": best.column("sim")})


def _matrix(block: pa.Table) -> np.ndarray:
    v = block.column("v").combine_chunks()
    return v.flatten().to_numpy().reshape(len(block), v.type.list_size)


def _at_least(sim: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k highest positive entries of each row that reach its ``least``; of equal ones the first."""
    keep = sim >= np.maximum(least, np.nextafter(0, 1))[:, None]
    many = np.flatnonzero(np.count_nonzero(keep, axis=1) > k)
    if len(many):
        part = sim[many]
        cut = np.partition(part, -k, axis=1)[:, -k]
        top = part >= cut[:, None]
        for r in np.flatnonzero(top.sum(axis=1) > k):
            at = np.flatnonzero(part[r] == cut[r])
            top[r, at[k - int((part[r] > cut[r]).sum()) :]] = False
        keep[many] = top
    return np.nonzero(keep)


def _no_rows(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _best(sim: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, extra: dict | None = None) -> pd.DataFrame:
    """The k best positive right entries of each left row; equal scores go to the smaller key."""
    by_key = np.argsort(right, kind="stable")
    sim, right = sim[:, by_key], right[by_key]
    sim = np.where(left[:, None] == right[None, :], -np.inf, sim)
    take = min(k, sim.shape[1])
    cut = np.partition(sim, -take, axis=1)[:, -take]
    best = (sim >= cut[:, None]) & (sim > 0)
    tied = np.flatnonzero(best.sum(axis=1) > take)
    for r in tied:  # columns stand in key order: of the entries at the cut the first ones stay
        at = np.flatnonzero(sim[r] == cut[r])
        best[r, at[take - int((sim[r] > cut[r]).sum()) :]] = False
    i, j = np.nonzero(best)
    return pd.DataFrame({**(extra or {}), "focal": left[i], "neighbor": right[j], "sim": sim[i, j]})


def fundamental_twins(
    panel: DataFrame, k: int = 5, coverage: float = 0.6, bound: float = 10.0, minimum: int = 10, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per month, the k most similar entities by cosine over their month-end variables.

    Input (month, entity, variable, value).  Entities with less than ``coverage`` of the
    month's variables are left out, missing variables count as 0, values are bounded, months
    with fewer than ``minimum`` entities are dropped.
    """
    d = settle(panel.withColumn("value", clean("value")).filter(F.col("value").isNotNull()))
    # a month has as many variables as the catalogue, so its distinct count is small
    nv = d.groupBy("month").agg(F.countDistinct("variable").alias("_nv"))
    vec = (
        d.groupBy("month", "entity")
        .agg(F.collect_list(F.struct("variable", clip("value", -bound, bound).alias("x"))).alias("_p"), F.count("*").alias("_c"))
        .join(nv, "month")
        .filter(F.col("_c") >= coverage * F.col("_nv"))
    )
    ok = vec.groupBy("month").agg(F.count("*").alias("_n")).filter(F.col("_n") >= minimum)
    vec = settle(vec.join(ok.select("month"), "month", "left_semi").select(
        "month", "entity", F.col("_p.variable").alias("_names"), F.col("_p.x").alias("_x")
    ))

    def fn(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["month", "focal", "neighbor", "sim"]
        if a.empty or b.empty:
            return _no_rows(*cols)
        names = sorted({v for r in (*a["_names"], *b["_names"]) for v in r})
        at = {v: i for i, v in enumerate(names)}

        def dense(p: pd.DataFrame) -> np.ndarray:
            m = np.zeros((len(p), len(names)))
            for r, (vs, xs) in enumerate(zip(p["_names"], p["_x"])):
                m[r, [at[v] for v in vs]] = xs
            return _unit(m)

        out = _best(dense(a) @ dense(b).T, a["entity"].to_numpy(), b["entity"].to_numpy(), k)
        out["month"] = a["month"].iloc[0]
        return out[cols]

    kind = panel.schema["entity"].dataType.simpleString()
    schema = f"month date, focal {kind}, neighbor {kind}, sim double"
    return top_per_focal(block_pairs(vec, "entity", ["month"], fn, schema, block_rows), k, ("month", "focal"))


def lead_lag_edges(
    returns: DataFrame, window: int = 252, overlap: int = 150, threshold: float = 0.15, ret: str = "ret",
    block_rows: int = 512,
) -> DataFrame:
    """Monthly edges leader -> follower: correlation of the follower with the leader's value
    one calendar row earlier over the trailing window, where it reaches ``threshold``.

    One row per (month end, entity) carries the entity's window as an array of at most
    ``window`` values; block tasks compute masked correlations and emit only real edges.
    """
    cal = returns.select("date").distinct().withColumn("_t", F.row_number().over(Window.orderBy("date")))
    ends = cal.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("_t").alias("_end")).filter(F.col("_end") >= window)
    d = returns.filter(F.col(ret).isNotNull()).join(cal, "date").select("entity", "_t", F.col(ret).alias("_r"))
    # the few month-end windows that cover a date, by date: calendar-sized, not data-sized
    cover = ends.withColumn("_t", F.explode(F.expr(f"sequence(_end - {window - 1}, _end)")))
    d = d.join(cover, "_t")
    vec = d.groupBy("month", "entity").agg(F.collect_list(F.struct((F.col("_t") - F.col("_end") + window - 1).alias("i"), F.col("_r").alias("x"))).alias("_p"))
    vec = vec.select("month", "entity", F.col("_p.i").alias("_i2"), F.col("_p.x").alias("_x"))

    def fn(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["month", "leader", "follower", "corr"]
        if a.empty or b.empty:
            return _no_rows(*cols)

        def dense(p: pd.DataFrame) -> np.ndarray:
            m = np.full((len(p), window), np.nan)
            for r, (i, x) in enumerate(zip(p["_i2"], p["_x"])):
                m[r, i] = x
            return m

        lead = dense(a)[:, :-1]   # the leader one row earlier
        foll = dense(b)[:, 1:]
        ml, mf = ~np.isnan(lead), ~np.isnan(foll)
        l0, f0 = np.where(ml, lead, 0.0), np.where(mf, foll, 0.0)
        mlf, mff = ml.astype(float), mf.astype(float)
        n = mlf @ mff.T
        sx, sy = l0 @ mff.T, mlf @ f0.T
        sxx, syy, sxy = (l0 * l0) @ mff.T, mlf @ (f0 * f0).T, l0 @ f0.T
        with np.errstate(invalid="ignore", divide="ignore"):
            c = (n * sxy - sx * sy) / np.sqrt((n * sxx - sx**2) * (n * syy - sy**2))
        lead_ok = ml.sum(axis=1) >= overlap
        keep = (n >= overlap) & np.isfinite(c) & (c >= threshold) & lead_ok[:, None]
        la, fb = a["entity"].to_numpy(), b["entity"].to_numpy()
        keep &= la[:, None] != fb[None, :]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"month": a["month"].iloc[0], "leader": la[i], "follower": fb[j], "corr": c[i, j]})[cols]

    kind = returns.schema["entity"].dataType.simpleString()
    return block_pairs(vec, "entity", ["month"], fn, f"month date, leader {kind}, follower {kind}, corr double", block_rows)


def correlated_pairs(df: DataFrame, cap: float, name: str = "variable", value: str = "value", block_rows: int = 512) -> DataFrame:
    """Pairs of series whose absolute correlation over common dates reaches ``cap``."""
    cal = df.select("date").distinct().withColumn("_t", F.row_number().over(Window.orderBy("date")) - 1)
    vec = df.filter(F.col(value).isNotNull()).join(cal, "date").groupBy(name).agg(
        F.collect_list(F.struct("_t", F.col(value).alias("x"))).alias("_p")
    ).select(name, F.col("_p._t").alias("_i2"), F.col("_p.x").alias("_x"))

    def fn(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _no_rows("a", "b", "corr")
        width = 1 + max(int(np.max(i)) for i in (*a["_i2"], *b["_i2"]))

        def dense(p):
            m = np.full((len(p), width), np.nan)
            for r, (i, x) in enumerate(zip(p["_i2"], p["_x"])):
                m[r, i] = x
            return m

        x, y = dense(a), dense(b)
        mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x0, y0 = np.nan_to_num(x), np.nan_to_num(y)
        n = mx @ my.T
        sx, sy, sxx, syy, sxy = x0 @ my.T, mx @ y0.T, (x0 * x0) @ my.T, mx @ (y0 * y0).T, x0 @ y0.T
        with np.errstate(invalid="ignore", divide="ignore"):
            c = (n * sxy - sx * sy) / np.sqrt((n * sxx - sx**2) * (n * syy - sy**2))
        na, nb = a[name].to_numpy(), b[name].to_numpy()
        i, j = np.nonzero(np.isfinite(c) & (np.abs(c) >= cap) & (na[:, None] < nb[None, :]))
        return pd.DataFrame({"a": na[i], "b": nb[j], "corr": c[i, j]})

    return block_pairs(vec, name, [], fn, "a string, b string, corr double", block_rows)


def greedy_prune(ordered: DataFrame, pairs: DataFrame, max_picks: int | None = None, most_rounds: int = 1_000) -> DataFrame:
    """(name, position) of the names kept in order unless too correlated with one kept before.

    In rounds: a name falls if a kept name before it clashes with it, and is kept once no
    undecided name before it does.  The first undecided name is always decided, and chains
    of clashes are short, so there are few rounds; each one is a join of the clashes with
    the names they concern.
    """
    names = settle(ordered.select("name", "position"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    early = names.select(F.col("name").alias("a"), F.col("position").alias("_pa"))
    late = names.select(F.col("name").alias("b"), F.col("position").alias("_pb"))
    clash = settle(both.join(early, "a").join(late, "b").filter("_pa < _pb").select("a", "b").distinct())
    open_, kept = names, None
    for _ in range(most_rounds):
        waiting = clash.join(open_.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        new = settle(open_.join(waiting, "name", "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        fallen = clash.join(new.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        open_ = settle(open_.join(new, "name", "left_anti").join(fallen, "name", "left_anti"))
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"greedy_prune: not decided after {most_rounds} rounds")
    return kept.orderBy("position").limit(max_picks) if max_picks else kept


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    a, b = a.cast("array<double>"), b.cast("array<double>")
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den > 0, dot(a, b) / den)


def nearest_to(df: DataFrame, key: str, vector: str, query_key, k: int = 10) -> DataFrame:
    """k most similar rows to one row; the query side is a single vector."""
    q = df.filter(F.col(key) == query_key).select(F.col(vector).alias("_q")).limit(1)
    return (
        df.filter(F.col(key) != query_key)
        .join(F.broadcast(q))
        .select(key, cosine(F.col(vector), F.col("_q")).alias("sim"))
        .orderBy(F.col("sim").desc_nulls_last(), key)
        .limit(k)
    )


def state_embedding(state: DataFrame, dims: int, max_missing: float = 0.5, most_variables: int = 5_000) -> DataFrame:
    """(entity, variable, value) -> PCA of the median-imputed, standardised state matrix.

    The variable list becomes the columns of the matrix; it is the catalogue of variables,
    not of data.  More than ``most_variables`` of them are refused before any fit, as a
    dense covariance of that width does not fit the driver.
    """
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler

    s = state.withColumn("value", clean("value")).filter(F.col("value").isNotNull())
    n = s.select("entity").distinct().count()
    good = [
        r[0] for r in s.groupBy("variable").agg(F.count("*").alias("c")).filter(F.col("c") >= (1 - max_missing) * n)
        .orderBy("variable").limit(most_variables + 1).collect()
    ]
    if len(good) > most_variables:
        raise ValueError(f"more than {most_variables} variables")
    wide = s.filter(F.col("variable").isin(*good)).groupBy("entity").pivot("variable", good).agg(F.first("value"))
    filled = Imputer(inputCols=good, outputCols=good, strategy="median").fit(wide).transform(wide)
    v = VectorAssembler(inputCols=good, outputCol="_raw").transform(filled)
    z = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(v).transform(v)
    p = PCA(k=min(dims, len(good)), inputCol="_z", outputCol="_e").fit(z).transform(z)
    from pyspark.ml.functions import vector_to_array

    return p.select("entity", vector_to_array("_e").alias("embedding"))


def nearest_analogs(features: DataFrame, target: str, k: int, as_of: str | None = None, key: str = "key") -> DataFrame:
    """k nearest episodes by Euclidean distance of per-feature percentile ranks.

    Long input (key, feature, value); keys that are dates after ``as_of`` are cut first.
    Distance accumulates per key; the target's row of ranks is joined by feature.
    """
    d = features
    if as_of:
        kd = F.col(key).cast("string").try_cast("date")
        d = d.filter(kd.isNull() | (kd <= F.lit(as_of).cast("date")))
    r = average_ranks(d, ["feature"], "value").withColumn("_p", F.col("rank") / F.col("group_n"))
    t = r.filter(F.col(key) == target).select("feature", F.col("_p").alias("_t"))
    return (
        r.filter(F.col(key) != target)
        .join(t, "feature")
        .groupBy(key)
        .agg(F.sqrt(F.sum((F.col("_p") - F.col("_t")) ** 2)).alias("distance"))
        .orderBy("distance", key)
        .limit(k)
    )


def best_per_group(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], cap: int, per_group: int = 1) -> DataFrame:
    """Best rows of each group by score, then the strongest ``cap`` of those (a queue)."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *tie)
    top = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_group).drop("_r")
    return top.orderBy(F.col(score).desc_nulls_last(), *tie).limit(cap)


def diversified(df: DataFrame, cls: str, score: str, tie: str, k: int, dedupe: Sequence[str] = ("entity", "direction")) -> DataFrame:
    """Strongest of every class first, then the rest by strength, k rows (a headline list).

    The strongest of a group is a grouped minimum, so a class of any size combines before it
    travels.  Behind fewer than k classes the 2 k strongest rows hold k that lead no class.
    """
    strength = lambda: F.struct(F.col(score).isNull(), -F.col(score), F.col(tie))
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    strongest = lambda d, by: d.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min_by(F.struct(*df.columns), strength()).alias("_r")).select("_r.*")
    d = strongest(df, dedupe)
    leaders = strongest(d, [cls]).orderBy(*order).limit(k).withColumn("_c", F.lit(0))
    few = leaders.unionByName(d.orderBy(*order).limit(2 * k).withColumn("_c", F.lit(1)))
    few = few.withColumn("_d", F.row_number().over(Window.partitionBy(*dedupe).orderBy("_c"))).filter("_d = 1")
    return few.orderBy("_c", *order).limit(k).drop("_d", "_c")
