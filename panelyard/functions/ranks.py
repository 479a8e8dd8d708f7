"""Exact ranks and quantiles of groups of any size, in one way for every size.

A window over a whole cross-section would put it into one task.  Here all groups together are
laid out by one range exchange, ordered by group and value, so that a large group spreads over
many tasks and a task holds many small groups.  The layout is settled once in the shared
folder; a piece is what one task holds of one group.  Every piece adds up its own rows, and
the sizes of the pieces before it in the same group, one row each, are added.  Where the range
exchange cuts only decides the pieces: the ranks are exact for any cuts.  Equal values are
counted before they are laid out, but for positions, whose ties are told apart by key.

A call runs jobs: it settles its layout, so the plan of its result holds neither the plan of
its input nor that of earlier calls, and nothing stays cached.  Group keys are compared
null-safe: NULL is a group like any other.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def join_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys are equal; the right side's keys are dropped."""
    names = {c: f"_on_{i}" for i, c in enumerate(on)}
    r = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for c, n in names.items():
        same = same & left[c].eqNullSafe(r[n])
    return left.join(r, same, how).drop(*names.values())


def laid_out(df: DataFrame, by: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df`` in ranges of (by, order), settled, with the piece of each row as ``_rw_p``.

    ``pieces`` fixes the number of ranges; by default it is that of the session's shuffle
    partitions, of which small ones are put together.
    """
    keys = [F.col(c) for c in (*by, *order)]
    laid = df.repartitionByRange(*([pieces] if pieces else []), *keys)
    # A struct is compared field by field, NULL being equal to NULL.
    return settle(laid.withColumn("_rw_p", F.struct(*[F.col(c) for c in by], F.spark_partition_id().alias("_rw_at"))))


def _around(by: Sequence[str]):
    """Windows over one row per piece: the pieces before, the pieces after, the whole group.

    What lies behind is taken from the other end: a frame that grows is kept up row by row,
    one that shrinks (to UNBOUNDED FOLLOWING) is summed anew for every row.
    """
    group = [F.col(f"_rw_p.{c}") for c in by]
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_rw_p._rw_at").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.col("_rw_p._rw_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return before, after, whole


def running_weight(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    weight: Column | None = None,
    cum: str = "_cum",
    total: str = "_total",
    values: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Add the inclusive running weight in ``order`` and the weight of the whole group.

    ``order`` must be unique within a group.  With weight 1 the running weight is the
    position.  ``values`` names a column for the rows of the group whose first column of
    ``order`` is not NULL.
    """
    by, order = list(by), list(order)
    d = laid_out(df.withColumn("_rw_w", (F.lit(1) if weight is None else weight).cast("long")), by, order, pieces)
    sizes = d.groupBy("_rw_p").agg(F.sum("_rw_w").alias("_rw_sum"), F.count(order[0]).alias("_rw_n"))
    before, _, whole = _around(by)
    sizes = sizes.select(
        F.col("_rw_p").alias("_rw_q"), F.coalesce(F.sum("_rw_sum").over(before), F.lit(0)).alias("_rw_off"), F.sum("_rw_sum").over(whole).alias(total),
        *([F.sum("_rw_n").over(whole).alias(values)] if values else []))
    local = Window.partitionBy("_rw_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_rw_local", F.sum("_rw_w").over(local))
    joined = d.join(sizes, d["_rw_p"] == sizes["_rw_q"])
    return joined.withColumn(cum, F.col("_rw_local") + F.col("_rw_off")).drop("_rw_local", "_rw_off", "_rw_w", "_rw_p", "_rw_q")


def least_from_here(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: Callable[[Column, Column], Column], out: str, pieces: int | None = None
) -> DataFrame:
    """Minimum of ``value(position, group size)`` over a row and all rows behind it.

    Two levels: every piece takes its own minima from its last row up, and of the pieces
    behind it one number each; time grows with the rows.  ``order`` must be unique within a
    group.
    """
    by, order = list(by), list(order)
    d = laid_out(df, by, order, pieces)
    before, after, whole = _around(by)
    sizes = d.groupBy("_rw_p").agg(F.count("*").alias("_rw_n"))
    sizes = sizes.select(F.col("_rw_p").alias("_rw_q"), F.coalesce(F.sum("_rw_n").over(before), F.lit(0)).alias("_rw_off"), F.sum("_rw_n").over(whole).alias("_rw_all"))
    o = Window.partitionBy("_rw_p").orderBy(*order)
    d = d.withColumn("_rw_local", F.row_number().over(o)).join(sizes, d["_rw_p"] == sizes["_rw_q"])
    d = d.withColumn("_rw_v", value(F.col("_rw_local") + F.col("_rw_off"), F.col("_rw_all")))
    up = Window.partitionBy("_rw_p").orderBy(F.col("_rw_local").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_rw_least", F.min("_rw_v").over(up))
    heads = d.filter("_rw_local = 1").select("_rw_p", "_rw_least")
    heads = heads.select(F.col("_rw_p").alias("_rw_h"), F.min("_rw_least").over(after).alias("_rw_behind"))
    d = d.join(heads, d["_rw_p"] == heads["_rw_h"])
    return d.withColumn(out, F.least("_rw_least", "_rw_behind")).drop("_rw_p", "_rw_q", "_rw_h", "_rw_off", "_rw_all", "_rw_local", "_rw_v", "_rw_least", "_rw_behind")


def positions(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: Sequence[str],
    descending: bool = False,
    out: str = "position",
    total: str = "group_n",
) -> DataFrame:
    """1..n position of each non-null value in its group; ties are broken by ``tie``.

    Rows of one value are ordered together, however many they are.
    """
    d = df.filter(F.col(value).isNotNull())
    d = d.withColumn("_rw_v", -F.col(value) if descending else F.col(value))
    return running_weight(d, by, ["_rw_v", *tie], cum=out, total=total).drop("_rw_v")


def histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs in its group; NULL values occur, with weight 0."""
    return df.groupBy(*by, value).agg(F.count(value).alias("_times"))


def average_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str = "rank",
    total: str = "group_n",
    distinct: str | None = None,
) -> DataFrame:
    """Tie-averaged ranks (1-based) of the non-null values; NULL values get NULL.

    A value shared by very many rows costs one row before the ranks are joined back.
    ``distinct`` names a column for the number of different values.
    """
    by = list(by)
    hist = histogram(df, by, value)
    r = running_weight(hist, by, [value], weight=F.col("_times"), total=total, values=distinct)
    has = F.col(value).isNotNull()
    r = r.withColumn(out, F.when(has, F.col("_cum") - (F.col("_times") - 1) / 2)).withColumn(total, F.when(has, F.col(total)))
    more = [distinct] if distinct else []
    return join_safe(df, r.select(*by, value, out, total, *more), [*by, value])


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per entry of ``probs``.

    Reads the two order statistics around each quantile off the exact positions.  A group
    without values has NULL quantiles.
    """
    by = list(by)
    r = running_weight(histogram(df, by, value), by, [value], weight=F.col("_times"))
    parts, finals = [], []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1

        def holds(k: Column) -> Column:
            return (F.col("_cum") >= k) & (F.col("_cum") - F.col("_times") < k)

        parts += [
            F.max(F.when(holds(lo), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(holds(hi), F.col(value))).alias(f"_{name}_hi"),
            F.max(at - F.floor(at)).alias(f"_{name}_w"),
        ]
        finals.append(
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
            ).alias(name)
        )
    return r.groupBy(*by).agg(*parts).select(*by, *finals)
