"""Point-in-time joins.

As-of joins are written as union + last value, interval joins on whole months as equi
joins, offset joins as joins on a row or month number: none needs a range condition over a
whole table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import month_number, month_start, series, so_far


def broadcast_globals(
    panel: DataFrame, variables: Sequence[str], entities: DataFrame
) -> DataFrame:
    """Rows that give every entity the named global series where it has none of its own."""
    g = (
        panel.filter(F.col("variable").isin(*variables))
        .groupBy("date", "variable", "source")
        .agg(F.max("value").alias("value"))
    )
    # The global series has one row per calendar date; the entity list multiplies it by
    # design, so each entity receives its own copy through a join on the variable.
    names = F.array(*[F.lit(v) for v in variables])
    want = entities.select("entity").distinct().withColumn("variable", F.explode(names))
    tiled = g.join(want, "variable")
    return tiled.join(panel.select("date", "variable", "entity"), ["date", "variable", "entity"], "left_anti").select(
        "date", "entity", "value", "variable", "source"
    )


def calendar_spine(df: DataFrame, trading: DataFrame) -> DataFrame:
    """Every entity on every date of its panel, with a trading flag.

    The date list rides along as one array (bounded by the calendar) and is exploded per
    entity.
    """
    dates = df.agg(F.array_sort(F.collect_set("date")).alias("_dates"))
    spine = df.select("entity").distinct().join(dates).select("entity", F.explode("_dates").alias("date"))
    flags = trading.select("entity", "date").distinct().withColumn("_t", F.lit(True))
    return spine.join(flags, ["entity", "date"], "left").select(
        "date", "entity", F.coalesce("_t", F.lit(False)).alias("is_trading_day")
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    on: str = "date",
    right_on: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Attach the latest right row at or before (``strict``: before) each left row.

    Of right rows with equal keys and dates the largest payload counts.  A very long key is cut by time: each side is bucketed by month, the last right row of
    every bucket is carried forward over buckets, and only rows of one (key, month) are
    ordered together.
    """
    by, right_on = list(by), right_on or on
    keep = [c for c in left.columns]
    l = left.withColumns({"_t": F.col(on), "_side": F.lit(0 if strict else 1)})
    payload = F.struct(F.col(right_on).alias("_at"), *values)
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_p"))
    r = r.withColumn("_m", month_start("_t"))
    l = l.withColumn("_m", month_start("_t"))
    # carry-in: the last right row before each month of the key
    last = r.groupBy(*by, "_m").agg(F.max_by("_p", F.struct("_t", "_p")).alias("_lastp"))
    months = l.select(*by, "_m").distinct().unionByName(r.select(*by, "_m").distinct()).distinct()
    w = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        months.join(last, [*by, "_m"], "left")
        .withColumn("_carry", F.last("_lastp", ignorenulls=True).over(w))
        .select(*by, "_m", "_carry")
    )
    u = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_m").orderBy("_t", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_hit", F.last("_p", ignorenulls=True).over(inside))
    u = u.filter(F.col("_side") == (0 if strict else 1)).drop("_p")
    return u.join(carry, [*by, "_m"], "left").withColumn("_hit", F.coalesce("_hit", "_carry")).select(
        *keep, F.col("_hit._at").alias(f"asof_{right_on}"), *[F.col(f"_hit.{v}").alias(v) for v in values]
    )


def latest_as_of(df: DataFrame, as_of: str | Column, keys: Sequence[str], order: str = "date") -> DataFrame:
    """The last row at or before a date per key; the largest of equal dates."""
    d = df.filter(F.col(order) <= (F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of))
    rest = [c for c in df.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def numbered(boundaries: DataFrame, on: str) -> DataFrame:
    """The different boundaries with their number ``_i`` from 1."""
    return boundaries.select(on).filter(F.col(on).isNotNull()).distinct().withColumn("_i", F.row_number().over(Window.orderBy(on)).cast("long"))


def with_boundaries_passed(df: DataFrame, boundaries: DataFrame, on: str = "date", inclusive: bool = False, out: str = "_passed") -> DataFrame:
    """Each row with the number of boundaries (see ``numbered``) before its date, or up to it.

    A row that holds from its date until the next row of its series then meets exactly the
    boundaries whose numbers lie between its count and that of the next row, so that an
    interval join is an equi join on dates and a lag.  Only different dates are ordered.
    """
    b = boundaries.columns[0]
    dates = df.select(F.col(on).alias("_d"), F.lit(0 if not inclusive else 1).alias("_side"), F.lit(0).alias("_one")).distinct()
    marks = boundaries.select(F.col(b).alias("_d"), F.lit(1 if not inclusive else 0).alias("_side"), F.lit(1).alias("_one"))
    upto = Window.orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    count = dates.unionByName(marks).withColumn(out, F.sum("_one").over(upto)).filter("_one = 0").select(F.col("_d").alias(on), out)
    return df.join(count, on)


def validity_intervals(vintages: DataFrame, by: Sequence[str], start: str = "applies_from") -> DataFrame:
    """[applies_from, applies_to) of successive vintages (the last one is open)."""
    v = vintages.select(*by, start).distinct()
    w = Window.partitionBy(*by).orderBy(start) if by else Window.orderBy(start)
    v = v.withColumn("applies_to", F.lead(start).over(w))
    return vintages.join(v, [*by, start])


def interval_months(
    facts: DataFrame, vintages: DataFrame, by: Sequence[str], start: str = "applies_from", on: str = "date"
) -> DataFrame:
    """Join facts to the vintage whose month interval holds their date.

    Each fact month is mapped to its vintage on the short list of months, then joined by
    equality on (by, vintage).
    """
    v = vintages.select(*by, month_start(start).alias("_from")).distinct()
    months = facts.select(*by, month_start(on).alias("_m")).distinct()
    u = months.select(*by, F.col("_m").alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast("date").alias("_from")).unionByName(
        v.select(*by, F.col("_from").alias("_t"), F.lit(0).alias("_s"), "_from")
    )
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_t", "_s")
    m = (
        u.withColumn("_v", F.last("_from", ignorenulls=True).over(so_far(w)))
        .filter("_s = 1 AND _v IS NOT NULL")
        .select(*by, F.col("_t").alias("_m"), F.col("_v").alias("_from"))
    )
    return (
        facts.withColumn("_m", month_start(on))
        .join(m, [*by, "_m"])
        .join(vintages.withColumn("_from", month_start(start)), [*by, "_from"])
        .drop("_m", "_from")
    )


def month_offset_returns(
    signal: DataFrame, returns: DataFrame, lag: int, horizon: int, ret: str = "ret", keys: Sequence[str] = ("entity",)
) -> DataFrame:
    """Signal of month M joined to the compounded return over (M+lag, M+lag+horizon].

    A cumulative log return per entity turns each window into two equi joins; both ends
    must be months the entity has.
    """
    keys = list(keys)
    c = returns.withColumn("_m", month_number("date")).withColumn(
        "_cum", F.sum(F.log1p(ret)).over(so_far(Window.partitionBy(*keys).orderBy("_m")))
    )
    a = c.select(*keys, (F.col("_m") - lag).alias("_m"), F.col("_cum").alias("_a"))
    b = c.select(*keys, (F.col("_m") - lag - horizon).alias("_m"), F.col("_cum").alias("_b"))
    return (
        signal.filter(F.col("value").isNotNull())
        .withColumn("_m", month_number("date"))
        .join(a, [*keys, "_m"])
        .join(b, [*keys, "_m"])
        .withColumn("fwd_return", F.expm1(F.col("_b") - F.col("_a")))
        .filter(F.col("fwd_return").isNotNull())
        .drop("_m", "_a", "_b")
    )


def day_offset_returns(
    signal: DataFrame, returns: DataFrame, lag: int, horizon: int, ret: str = "ret"
) -> DataFrame:
    """Signal on an entity's trading day t joined to its return over (t+lag, t+lag+horizon]
    of its own calendar."""
    w = Window.partitionBy("entity").orderBy("date")
    c = returns.filter(F.col(ret).isNotNull()).withColumns(
        {"_i": F.row_number().over(w), "_cum": F.sum(F.log1p(ret)).over(so_far(w))}
    )
    # lead() on the entity's own calendar replaces both position joins
    fwd = c.withColumns({"_a": F.lead("_cum", lag).over(w) if lag else F.col("_cum"), "_b": F.lead("_cum", lag + horizon).over(w)})
    fwd = fwd.filter(F.col("_b").isNotNull()).select("entity", "date", F.expm1(F.col("_b") - F.col("_a")).alias("fwd_return"))
    return signal.filter(F.col("value").isNotNull()).join(fwd, ["entity", "date"])


def attach_same_year(df: DataFrame, annual: DataFrame, name: str, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Attach the latest annual value of the same calendar year (left join)."""
    a = annual.filter(F.col("value").isNotNull()).groupBy(*by, F.year("date").alias("_y")).agg(
        F.max_by("value", "date").alias(name)
    )
    return df.withColumn("_y", F.year("date")).join(a, [*by, "_y"], "left").drop("_y")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], value: str, on: str = "date") -> DataFrame:
    """Value of the right row nearest in time on either side (earlier wins a tie).

    Two as-of lookups, backward and (on negated time) forward, instead of all pairs per key.
    """
    back = asof(left, right, by, [value], on).withColumnsRenamed({f"asof_{on}": "_bt", value: "_bv"})
    fwd = _forward(left, right, by, value, on)
    j = back.join(fwd, [*by, on], "left")
    near_back = F.datediff(on, "_bt")
    near_fwd = F.datediff("_ft", on)
    use_fwd = F.col("_bt").isNull() | (near_fwd < near_back)
    return j.withColumns(
        {value: F.when(use_fwd, F.col("_fv")).otherwise(F.col("_bv")),
         "matched": F.when(use_fwd, F.col("_ft")).otherwise(F.col("_bt"))}
    ).drop("_bt", "_bv", "_ft", "_fv")


def _forward(left: DataFrame, right: DataFrame, by: Sequence[str], value: str, on: str) -> DataFrame:
    epoch = F.lit("1970-01-01").cast("date")
    neg = F.date_sub(epoch, F.datediff(F.col(on), epoch))
    l = left.select(*by, on).distinct().withColumn("_neg", neg)
    r = right.select(*by, neg.alias("_neg"), F.col(on).alias("_ft"), F.col(value).alias("_fv"))
    return asof(l, r, by, ["_ft", "_fv"], "_neg").select(*by, on, "_ft", "_fv")


def events_overlapping(
    events: DataFrame, start: str, end: str, entity: str | None = None, category: str | None = None,
    severity: Sequence[int] | None = None, tags: Sequence[str] | None = None,
) -> DataFrame:
    """Events whose date, or date range, meets a window; an entity also sees global events."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = events.filter((F.col("event_date") <= e) & (F.coalesce("end_date", "event_date") >= s))
    if category:
        d = d.filter(F.col("category") == category)
    if severity:
        d = d.filter(F.col("severity").isin(*severity))
    if entity:
        named = F.array_contains(F.transform(F.split("countries_affected", ","), lambda x: F.trim(x)), entity)
        d = d.filter(F.coalesce(F.col("is_global"), F.lit(False)) | F.coalesce(named, F.lit(False)))
    if tags:
        have = F.transform(F.split("tags", ","), lambda x: F.trim(x))
        d = d.filter(F.arrays_overlap(have, F.array(*[F.lit(t) for t in tags])))
    return d


def prefer(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Row-level coalesce of two sources by key: a where it has a value, else b."""
    return a.select(*keys, F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), list(keys), "full"
    ).select(*keys, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "first").otherwise("second").alias("origin"))


def prefer_entities(a: DataFrame, b: DataFrame, key: str = "entity") -> DataFrame:
    """Source b only for the entities that a does not cover at all."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def apply_benchmark(df: DataFrame, region_of: DataFrame, factors: DataFrame) -> DataFrame:
    """Entity -> region map, then the region's factors by date."""
    return df.join(region_of, "entity").join(factors, ["region", "date"])


def consistency(daily: DataFrame, monthly: DataFrame, minimum: int = 12) -> DataFrame:
    """Month-end of a daily panel against the stored monthly values, per variable."""
    me = daily.groupBy("entity", "variable", month_start("date").alias("date")).agg(
        F.max_by("value", "date").alias("_d")
    )
    j = me.join(monthly.select("entity", "variable", "date", F.col("value").alias("_m")), ["entity", "variable", "date"])
    return j.groupBy("variable").agg(
        F.count("*").alias("n"), F.corr("_d", "_m").alias("correlation"), F.avg(F.abs(F.col("_d") - F.col("_m"))).alias("mean_abs_diff")
    ).filter(F.col("n") >= minimum)


def mirror_fill(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rebuild reporters that report nothing from what their counterparts report.

    Columns: src, dst, year, exports, imports.  Mirrored rows swap the roles; the share of
    each partner in the reporter's total follows.
    """
    e = edges.withColumn("mirrored", F.lit(False))
    missing = e.select(F.col(dst).alias("_x")).distinct().join(
        e.select(F.col(src).alias("_x")).distinct(), "_x", "left_anti"
    )
    back = e.join(missing, F.col(dst) == F.col("_x")).select(
        F.col(dst).alias(src), F.col(src).alias(dst), "year",
        F.col("imports").alias("exports"), F.col("exports").alias("imports"), F.lit(True).alias("mirrored"),
    )
    u = e.unionByName(back).withColumn("total", F.col("exports") + F.col("imports"))
    tot = u.groupBy(src, "year").agg(F.sum("total").alias("_t"))
    return u.join(tot, [src, "year"]).withColumn(
        "share_pct", F.when(F.col("_t") != 0, F.col("total") / F.col("_t") * 100).otherwise(0.0)
    ).drop("_t")


def month_snapshot(df: DataFrame, keys: Sequence[str] = ("entity", "variable")) -> DataFrame:
    """Rows of each entity's last date of the month (all its variables on that date)."""
    last = df.groupBy("entity", month_start("date").alias("month")).agg(F.max("date").alias("date"))
    return df.join(last, ["entity", "date"])
