"""Interaction of five document filters over all orders in which they can be applied.

Every document becomes a mask of the filters that it fails.  Documents of one part (language)
and mask are counted into a cell, at most 32 a part; the audit itself then works on cells
alone.  A recursive CTE extends prefixes of filters by the letters they do not hold yet,
joins the cells and carries the bits applied so far; each level emits the metrics of its
step, so that the 120 orders share the metrics of their 325 common prefixes.

A fails with under 200 words, B with fewer than half as many different words as words, C with
over 3 % of ``[A-Z]`` among the code points, D with any of ``[#$%&*|]``, E if the text is that
of a smaller id anywhere in the table, whether that row is removed or not.
"""
from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_key, written

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
#: Groups of parts; a level of the recursion has one row per prefix and group.
BLOCKS = 64


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the failures of A, B, C and D; NULL is an empty text."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    n = F.size(words)
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.regexp_count(t, F.lit("[A-Z]")) > 3 * F.length(t), t.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for i, f in enumerate(fails):
        mask = mask + F.when(f, 1 << i).otherwise(0)
    return mask


def document_masks(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with the column ``mask`` (int) of all five filters.

    A row without an id is never a copy and makes none; of rows that agree in id and text
    none is a copy of another.  The smallest id of each text is a grouped minimum, and the
    join back is on (text, id), so a text that a third of all rows hold is no hot key.
    """
    key, own, low, is_ = free_names(docs, "key", "own", "low", "first")
    d = docs.withColumn(own, text_mask(F.col(f"`{text}`"))).withColumn(key, text_key(text)).drop(text)
    d = written(d.drop("mask"), "audit-rows")
    first = d.groupBy(key).agg(F.min(f"`{id}`").alias(low)).filter(F.col(low).isNotNull())
    marks = first.select(F.col(key).alias(is_), F.col(low))
    same = (d[key] == marks[is_]) & (d[f"`{id}`"] == marks[low])
    known = d.filter(F.col(f"`{id}`").isNotNull()).join(marks, same, "left")
    nameless = d.filter(F.col(f"`{id}`").isNull()).withColumn(is_, F.col(key)).withColumn(low, F.col(f"`{id}`"))
    copy = F.when(F.col(is_).isNull(), 1 << 4).otherwise(0)
    return known.unionByName(nameless).withColumn("mask", F.col(own) + copy).drop(key, own, low, is_)


def mask_cells(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row (part, mask, n, good, toxic) per part and mask that occurs.

    good and toxic count the documents whose id has any label row with quality 1 or toxic 1.
    NULL parts are the empty string.
    """
    masks = document_masks(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")), "id", "text")
    told = labels.filter(F.col(f"`{id}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("g"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"))
    known = masks.filter("id is not null").join(told, "id", "left")
    nameless = masks.filter("id is null").withColumn("g", F.lit(0)).withColumn("t", F.lit(0))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("g"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("toxic"))


def _total(field: str, when: str) -> str:
    return f"aggregate(p.cells, 0L, (a, x) -> a + if({when}, x.{field}, 0L))"


def prefix_steps(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row (prefix, letter, part, metrics) per prefix of filters and part.

    The metrics are those of the prefix's last filter.  The recursion takes the parts in
    ``BLOCKS`` groups, so that its number of rows does not depend on theirs.
    """
    spark = cells.sparkSession
    letters = spark.createDataFrame([(c, 1 << i) for i, c in enumerate(filters)], "letter string, bit int")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    groups = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(BLOCKS)).alias("grp")).agg(F.collect_list(F.struct("part", "cells")).alias("parts"))
    groups = written(groups, "audit-groups")
    fails, early = "(x.mask & l.bit) <> 0", "(x.mask & s.applied) <> 0"
    removed = f"{fails} AND NOT {early}"
    steps = spark.sql(f"""
        WITH RECURSIVE steps(grp, prefix, letter, applied, metrics) AS (
            SELECT grp, '', '', 0, CAST(NULL AS array<struct<part string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long>>)
            FROM {{groups}}
            UNION ALL
            SELECT g.grp, concat(s.prefix, l.letter), l.letter, s.applied | l.bit, transform(g.parts, p -> named_struct(
                'part', p.part,
                'kept', {_total('n', '(x.mask & (s.applied | l.bit)) = 0')},
                'removed', {_total('n', removed)},
                'redundant', {_total('n', f'{fails} AND {early}')},
                'unique_fails', {_total('n', 'x.mask = l.bit')},
                'good_lost', {_total('good', removed)},
                'toxic_lost', {_total('toxic', removed)}))
            FROM steps s JOIN {{letters}} l ON (s.applied & l.bit) = 0 JOIN {{groups}} g ON g.grp = s.grp)
        SELECT prefix, letter, inline(metrics) FROM steps WHERE prefix <> ''""", groups=groups, letters=letters)
    return written(steps, "audit-steps")


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of all filters and step, with the metrics of that step.

    cells: rows (part, mask, n, good, toxic); bit i of mask is set where filter i fails.
    ``shapley`` is the number that the step's filter removes, summed over all orders.  A
    part occurs if it has a document; no cells give no rows.
    """
    size = len(filters)
    steps = prefix_steps(cells, filters)
    times = F.element_at(F.array(*[F.lit(factorial(size - k)) for k in range(1, size + 1)]), F.length("prefix"))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * times).alias("shapley"))
    orders = steps.filter(F.length("prefix") == size).select(F.col("prefix").alias("filter_order")).distinct()
    taken = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    taken = taken.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return taken.join(steps, "prefix").join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five text filters by ``part``; other columns are not read.

    NULL and empty texts fail A alone; NULL ids are never copies; repeated rows all count;
    labels without id or of unknown ids are ignored.
    """
    return audit(written(mask_cells(docs, labels, id, text, part), "audit-cells"))
