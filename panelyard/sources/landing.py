"""Landed files -> tidy rows: scans, melts, nested documents, text cleaning."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import clean
from . import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path (or glob) exist on the file system its scheme names?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a fixed schema: casts, missing columns as NULL, doubles cleaned."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append((clean(c) if isinstance(f.dataType, T.DoubleType) else c.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def read_panel(spark: SparkSession, path: str, schema: T.StructType = schemas.TIDY) -> DataFrame:
    """Parquet panel with casts to the fixed schema (filters and columns reach the scan)."""
    return conform(spark.read.parquet(path), schema)


def read_csv_panel(spark: SparkSession, path: str, schema: T.StructType = schemas.TIDY) -> DataFrame:
    return conform(spark.read.schema(schema).csv(path, header=True), schema)


def read_first_available(
    spark: SparkSession, candidates: Sequence[str], schema: T.StructType = schemas.TIDY
) -> DataFrame:
    """The first existing of several csv/parquet locations, else a typed empty table."""
    for path in candidates:
        if path_exists(spark, path):
            reader = read_csv_panel if path.rstrip("/").endswith(".csv") else read_panel
            return reader(spark, path, schema)
    return schemas.empty(spark, schema)


def melt(
    wide: DataFrame, ids: Sequence[str], name: str = "entity", value: str = "value", keep_null: bool = False
) -> DataFrame:
    """Wide sheet -> long rows; every non-id column is a member of the melted axis."""
    cols = [c for c in wide.columns if c not in ids]
    d = wide.select(*ids, *[clean(c).alias(c) for c in cols]).unpivot(list(ids), cols, name, value)
    return d if keep_null else d.filter(F.col(value).isNotNull())


def factor_returns_from_wide(wide: DataFrame, source: str) -> DataFrame:
    """Optimizer sheet -> (month, factor, value); only the normalised factors are kept."""
    return (
        melt(wide, ["date"], "factor")
        .filter(F.col("factor").rlike("_(CS|TS)$"))
        .select(F.trunc("date", "month").alias("date"), "factor", "value", F.lit(source).alias("source"))
    )


def membership_from_wide(wide: DataFrame, factor: str, source: str) -> DataFrame:
    """Exposure sheet (date x entity) -> sparse positive weights."""
    return melt(wide, ["date"], "entity", "weight").filter(F.col("weight") > 0).withColumns(
        {"factor": F.lit(factor), "source": F.lit(source)}
    )


def sentinel_to_null(c: Column, sentinels: Sequence[float] = (-99.99, -999.0)) -> Column:
    return F.when(~c.isin(*[float(s) for s in sentinels]), c)


def read_sentinel_table(wide: DataFrame, ids: Sequence[str], sentinels: Sequence[float] = (-99.99, -999.0)) -> DataFrame:
    """Wide numeric text table with sentinel codes for missing -> long rows."""
    cols = [c for c in wide.columns if c not in ids]
    d = wide.select(*ids, *[sentinel_to_null(clean(c), sentinels).alias(c) for c in cols])
    return melt(d, ids, "variable")


SERIES_DOC = T.StructType(
    [
        T.StructField(
            "series",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("entity", T.StringType()),
                        T.StructField("indicator", T.StringType()),
                        T.StructField("observations", T.MapType(T.StringType(), T.StringType())),
                    ]
                ),
            ),
        )
    ]
)


def nested_series(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON documents holding a map of series, each a map of period -> text value."""
    d = df.select(F.from_json(payload, SERIES_DOC).alias("d"))
    s = d.select(F.explode("d.series").alias("key", "s"))
    o = s.select(
        F.col("s.entity").alias("entity"),
        F.col("s.indicator").alias("variable"),
        F.explode("s.observations").alias("period", "text"),
    )
    return o.select(
        period_to_date(F.col("period")).alias("date"), "entity", "variable", "period", number(F.col("text")).alias("value")
    ).filter(F.col("date").isNotNull() & F.col("value").isNotNull())


def period_to_date(p: Column) -> Column:
    """2020-M03 / 2020-03 -> the month; 2020-Q1 / 2020Q1 -> the quarter's last month;
    2020 -> December; anything else NULL."""
    year = F.regexp_extract(p, r"^(\d{4})", 1).cast("int")
    month = F.regexp_extract(p, r"^\d{4}-M?(\d{1,2})$", 1)
    quarter = F.regexp_extract(p, r"^\d{4}-?Q([1-4])$", 1)
    m = (
        F.when(month != "", month.cast("int"))
        .when(quarter != "", quarter.cast("int") * 3)
        .when(p.rlike(r"^\d{4}$"), F.lit(12))
    )
    return F.when(m.between(1, 12), F.make_date(year, m, F.lit(1)))


def number(text: Column) -> Column:
    """Text to double: thousands separators, percent signs, parentheses for negatives;
    error marks and anything else unparsable become NULL."""
    t = F.trim(text)
    negative = t.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(t, r"[(),%$\s]", "")
    v = bare.try_cast("double")
    return F.when(negative, -v).otherwise(clean(v))


# The 21-point scale of the agencies' grades, default 0.
RATING_SCALE = {
    "AAA": 21, "AA+": 20, "AA": 19, "AA-": 18, "A+": 17, "A": 16, "A-": 15,
    "BBB+": 14, "BBB": 13, "BBB-": 12, "BB+": 11, "BB": 10, "BB-": 9,
    "B+": 8, "B": 7, "B-": 6, "CCC+": 5, "CCC": 4, "CCC-": 3, "CC": 2, "C": 1, "D": 0, "SD": 0, "RD": 0,
    "Aaa": 21, "Aa1": 20, "Aa2": 19, "Aa3": 18, "A1": 17, "A2": 16, "A3": 15, "Baa1": 14, "Baa2": 13, "Baa3": 12,
    "Ba1": 11, "Ba2": 10, "Ba3": 9, "B1": 8, "B2": 7, "B3": 6, "Caa1": 5, "Caa2": 4, "Caa3": 3, "Ca": 2,
}


def rating_score(raw: Column) -> Column:
    """Rating text -> score; watch marks and unsolicited suffixes are stripped, unknown is NULL."""
    t = F.regexp_replace(F.trim(raw), r"\*[+-]|\(P\)| PRELIM", "")
    t = F.regexp_replace(F.trim(t), r"[ue]+$", "")
    scale = F.create_map(*[x for k, v in RATING_SCALE.items() for x in (F.lit(k), F.lit(float(v)))])
    return scale[F.trim(t)]


def range_gate(
    df: DataFrame, bounds: dict[str, tuple[float, float]], max_bad: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """Drop values outside (lo, hi] by variable prefix (longest prefix wins).

    Returns the kept rows and one gate row per (variable, entity).  Writing is refused by
    ``assert_gate`` if more than ``max_bad`` of a series is out of range or has no bounds.
    """
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for prefix in sorted(bounds, key=len):
        hit = F.col("variable").startswith(prefix)
        lo = F.when(hit, F.lit(float(bounds[prefix][0]))).otherwise(lo)
        hi = F.when(hit, F.lit(float(bounds[prefix][1]))).otherwise(hi)
    d = df.withColumn("_bad", (F.col("value") <= lo) | (F.col("value") > hi))
    gate = d.groupBy("variable", "entity").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("_bad"), 1)).alias("n_bad"),
        F.count(F.when(F.col("_bad").isNull(), 1)).alias("n_unbounded"),
    ).withColumn("refuse", (F.col("n_bad") > max_bad * F.col("n")) | (F.col("n_unbounded") > 0))
    return d.filter(~F.col("_bad")).drop("_bad"), gate


def assert_gate(gate: DataFrame) -> None:
    bad = gate.filter("refuse").limit(5).collect()
    if bad:
        raise ValueError(f"range gate refuses to write: {[r.asDict() for r in bad]}")


def workbook_tables(
    wide: DataFrame, meta: DataFrame, categories: dict[str, Sequence[str]], other: str = "other"
) -> DataFrame:
    """Price sheet + series metadata -> long prices with a category by code prefix."""
    cat = F.lit(other)
    for name, prefixes in categories.items():
        for p in prefixes:
            cat = F.when(F.col("series_code").startswith(p), name).otherwise(cat)
    return melt(wide, ["date"], "series_code").join(meta, "series_code", "left").withColumn("category", cat)


def annual_history(wide: DataFrame, ids: Sequence[str] = ("year", "entity", "iso3"), rename: dict[str, str] | None = None) -> DataFrame:
    """Annual wide history -> tidy (date, year, entity, iso3, variable, value), labels remapped."""
    d = melt(wide, list(ids), "variable")
    if rename:
        m = F.create_map(*[x for k, v in rename.items() for x in (F.lit(k), F.lit(v))])
        d = d.withColumn("entity", F.coalesce(m[F.col("entity")], F.col("entity")))
    return d.withColumn("date", F.make_date(F.col("year").cast("int"), F.lit(12), F.lit(31)))


def provider_extract(df: DataFrame, measures: dict[str, str], unit: str) -> DataFrame:
    """Dashboard extract: rows of the expected unit and known measures, as tidy rows."""
    m = F.create_map(*[x for k, v in measures.items() for x in (F.lit(k), F.lit(v))])
    return (
        df.filter((F.col("unit") == unit) & F.col("measure").isin(*measures))
        .withColumn("variable", m[F.col("measure")])
        .withColumn("value", number(F.col("text")))
        .filter(F.col("value").isNotNull())
        .select("date", "entity", "variable", "value")
    )


def flow_subtotals(df: DataFrame, order: str = "line") -> DataFrame:
    """Flow table lines -> net flow per date and category.

    Lines carry their headers only on the first line of a block: date and category are
    carried down within a report (``report`` is the partition), sub-total lines are kept and
    the route of an investment follows from the category name.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("report").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns(
        {"date": F.last("date", ignorenulls=True).over(w), "category": F.last("category", ignorenulls=True).over(w)}
    )
    return (
        d.filter(F.lower("label") == "sub-total")
        .withColumn("route", F.when(F.lower("category").contains("equity"), "equity").when(F.lower("category").contains("debt"), "debt").otherwise("other"))
        .groupBy("date", "category", "route")
        .agg(F.sum(number(F.col("net"))).alias("net"))
    )
