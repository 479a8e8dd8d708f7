"""Reading tables, written intermediate tables and connected components."""
from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own, none of them (in any case) a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def apart(*named: str) -> Callable:
    """Decorator: the caller's columns bear neutral names while the operator runs.

    ``named`` are the parameters that hold names of columns of the first argument.  So no
    column of the caller can meet one of the operator's own, whatever its name; columns
    named (in any case) like an output give way to it.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(df: DataFrame, *args, **kw) -> DataFrame:
            neutral = {c: f"__{i}" for i, c in enumerate(df.columns)}
            bound = signature.bind(df.toDF(*neutral.values()), *args, **kw)
            bound.apply_defaults()
            for n in named:
                bound.arguments[n] = neutral[bound.arguments[n]]
            out = f(*bound.args, **bound.kwargs)
            back = {n: c for c, n in neutral.items()}
            made = {c.lower() for c in out.columns if c not in back}
            return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in made])

        return run

    return wrap


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share.

    Settling an empty row lets the session helper decide where that folder is.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        settle(spark.range(0))
    return f"{sc.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Return memory that is free in this process, Arrow's and the allocator's, to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; what a task no longer needs does not stay with the worker, which
    waits beside the JVM while other stages run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lineage ends there, and Catalyst knows the table's size in bytes, so that it broadcasts
    it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = work_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list as rows (node, root).

    Large-star and small-star rounds (Kiveris et al. 2014): each round hangs neighbours on
    the smallest node they know of; it ends when a round changes nothing.  Every round is a
    grouped minimum, which combines before the shuffle, and one join on the node, which AQE
    splits where a hub is large.  root is the smallest node of the component.  NULL ends and
    loops are ignored; an empty edge list gives no rows.
    """
    e = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    mark = None
    for _ in range(most_rounds):
        # Large star: all larger neighbours of a node move to its smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = settle(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Bits of the filters that keep rows from travelling, however many keys they stand for.
FILTER_BITS = 24


def marked(df: DataFrame, on: list[str], keys: DataFrame, mark: str = "_maybe", bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with a boolean: whether its columns ``on`` may be a row of ``keys``.

    It is true for all that are one, and for a few others by chance.  The keys set bits at the
    place of their hash; every task gets these words, at most ``bits`` bits, so that no row of
    ``df`` moves.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = keys.select(place.alias("_place")).groupBy(F.expr("_place >> 6").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = df.withColumn("_place", place).withColumn("_word", F.expr("_place >> 6")).join(F.broadcast(words), "_word", "left")
    return out.withColumn(mark, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_place", "_bits")


def likely_in(df: DataFrame, on: list[str], keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose columns ``on`` may be a row of ``keys``: see ``marked``."""
    return marked(df, on, keys, bits=bits).filter("_maybe").drop("_maybe")


def text_key(text: str) -> Column:
    """128 bits that stand for a text; NULL counts as empty."""
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def first_of_each(df: DataFrame, labels: DataFrame, id: str, text: str, bits: int = FILTER_BITS) -> DataFrame:
    """One row of ``df`` for each component of its texts; all columns are kept.

    labels has one row (_key, component_id) for each ``text_key``.  The row with the smallest
    (id, key) stays, rows without an id behind all others; of rows that agree in both, one.
    Only rows that may go, or that come more than once, are moved.
    """
    keyed = written(df.select(F.col(f"`{id}`").alias("_id"), text_key(text).alias("_key")).groupBy("_id", "_key").agg(F.count("*").alias("_times")), "first-keys")
    low = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key")).alias("_low")
    lows = keyed.join(labels, "_key").groupBy("component_id").agg(low)

    def row(i: str, key: Column) -> Column:
        return F.concat(key, F.when(F.col(i).isNull(), "").otherwise(F.concat(F.lit("="), F.col(i).cast("string"))))

    stay = written(lows.select(row("_low._id", F.col("_low._key")).alias("_row")), "first-rows")
    known = keyed.select(row("_id", F.col("_key")).alias("_row"), "_times")
    unsure = known.join(stay, "_row", "left_anti").select("_row").unionByName(known.filter("_times > 1").select("_row"))
    rows = marked(df.withColumn("_row", row(f"`{id}`", text_key(text))), ["_row"], written(unsure, "first-unsure"), "_unsure", bits)
    # The join and the choice among equal rows share one distribution of the rows.
    moved = rows.filter("_unsure").join(stay, "_row", "left_semi").dropDuplicates(["_row"])
    return rows.filter("not _unsure").unionByName(moved).drop("_row", "_unsure")
