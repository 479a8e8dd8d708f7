"""Decorator, table access and the shared panels of the registered queries."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIGITS = 6
_REGISTRY: dict[str, "Query"] = {}


class Tables:
    """The given tables by name, and the panels derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    floats: tuple[str, ...]
    digits: int = DIGITS

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.build(Tables(spark, path))
        return df.withColumns({c: F.round(F.col(c), self.digits) for c in self.floats}) if self.floats else df

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_panels(self.sql)
        if not self.floats:
            return body
        fixes = ", ".join(f'round("{c}", {self.digits}) + 0.0 AS "{c}"' for c in self.floats)
        return f"SELECT * REPLACE ({fixes}) FROM ({body})"


def registered(name: str) -> Query:
    return _REGISTRY[name]


def query(name: str, sql: str | None = None, floats: str = "", digits: int = DIGITS):
    """Register ``fn(tables) -> DataFrame``; ``floats`` are rounded on both sides."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"query {name} registered twice")
        _REGISTRY[name] = Query(name, fn, sql, tuple(floats.split()), digits)
        return fn

    return wrap


# --- shared panels: Spark builders and the same panels as SQL common table expressions ---

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def supplier_nation(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("entity"), "n_regionkey"
    )


def customer_nation(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("entity")
    )


# The facts are joined to their dimension first and then summed once: the sums combine
# map-side to (date x nation) groups, so what is shuffled for them is tiny.  The dimension is
# broadcast only if its measured size allows it; otherwise the facts are shuffled once by key.


def monthly(t: Tables) -> DataFrame:
    """Shipped revenue per month, supplier nation and return flag."""
    return (
        t.lineitem.join(supplier_nation(t), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.trunc("l_shipdate", "month").alias("date"), "entity", F.col("l_returnflag").alias("variable"))
        .agg(F.round(F.sum(revenue()), 4).alias("value"))
    )


def daily(t: Tables) -> DataFrame:
    """Shipped revenue per day and supplier nation (days without shipments are absent)."""
    return (
        t.lineitem.join(supplier_nation(t), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.to_date("l_shipdate").alias("date"), "entity")
        .agg(F.round(F.sum(revenue()), 4).alias("value"))
        .withColumn("variable", F.lit("REV"))
    )


def sales(t: Tables) -> DataFrame:
    """Ordered amount per month and customer nation."""
    return (
        t.orders.join(customer_nation(t), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.trunc("o_orderdate", "month").alias("date"), "entity")
        .agg(F.round(F.sum("o_totalprice"), 4).alias("value"))
        .withColumn("variable", F.lit("SALES"))
    )


def _as_returns(levels: DataFrame) -> DataFrame:
    """A bounded return from successive levels: a tenth of the symmetric change."""
    prev = F.lag("value").over(Window.partitionBy("entity").orderBy("date"))
    return (
        levels.withColumn("_p", prev)
        .filter(F.col("_p").isNotNull())
        .select(
            "date",
            "entity",
            ((F.col("value") - F.col("_p")) / (F.col("value") + F.col("_p")) * 0.1).alias("ret"),
        )
    )


def mret(t: Tables) -> DataFrame:
    return _as_returns(sales(t))


def dret(t: Tables) -> DataFrame:
    return _as_returns(daily(t))


def user_daily(t: Tables) -> DataFrame:
    """Event value per day, user and event type."""
    return (
        t.events.groupBy(
            F.to_date("ts").alias("date"),
            F.col("user_id").alias("entity"),
            F.col("event_type").alias("variable"),
        )
        .agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))
    )


def trade(t: Tables) -> DataFrame:
    """Yearly flows from supplier nation (src) to customer nation (dst)."""
    orders = (
        t.orders.join(customer_nation(t).withColumnRenamed("entity", "dst"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "dst", F.year("o_orderdate").cast("long").alias("year"))
    )
    lines = t.lineitem.join(
        supplier_nation(t).withColumnRenamed("entity", "src"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select("l_orderkey", "src", revenue().alias("_v"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("year", "src", "dst")
        .agg(F.round(F.sum("_v"), 4).alias("weight"))
    )


PANELS = {
    "monthly": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, n_name AS entity,
        l_returnflag AS variable, round(sum(l_extendedprice*(1-l_discount)),4) AS value
      FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
      GROUP BY 1,2,3""",
    "daily": """SELECT CAST(l_shipdate AS DATE) AS date, n_name AS entity,
        round(sum(l_extendedprice*(1-l_discount)),4) AS value, 'REV' AS variable
      FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
      GROUP BY 1,2""",
    "sales": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_name AS entity,
        round(sum(o_totalprice),4) AS value, 'SALES' AS variable
      FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
      GROUP BY 1,2""",
    "mret": """SELECT date, entity, (value-p)/(value+p)*0.1 AS ret FROM
      (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY date) AS p FROM sales) WHERE p IS NOT NULL""",
    "dret": """SELECT date, entity, (value-p)/(value+p)*0.1 AS ret FROM
      (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY date) AS p FROM daily) WHERE p IS NOT NULL""",
    "user_daily": """SELECT CAST(ts AS DATE) AS date, user_id AS entity, event_type AS variable,
        round(sum(value),4) AS value, count(*) AS n FROM events GROUP BY 1,2,3""",
    "trade": """SELECT year(o_orderdate) AS year, sn.n_name AS src, cn.n_name AS dst,
        round(sum(l_extendedprice*(1-l_discount)),4) AS weight
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey
      JOIN supplier ON l_suppkey=s_suppkey JOIN nation sn ON s_nationkey=sn.n_nationkey
      JOIN customer ON o_custkey=c_custkey JOIN nation cn ON c_nationkey=cn.n_nationkey
      GROUP BY 1,2,3""",
}
_NEEDS = {"mret": ["sales"], "dret": ["daily"]}


def with_panels(sql: str) -> str:
    """Prefix the common table expressions a query text mentions as ``{name}``."""
    wanted: list[str] = []
    for name in PANELS:
        if "{" + name + "}" in sql:
            for dep in [*_NEEDS.get(name, []), name]:
                if dep not in wanted:
                    wanted.append(dep)
            sql = sql.replace("{" + name + "}", name)
    if not wanted:
        return sql
    ctes = ", ".join(f"{n} AS MATERIALIZED ({PANELS[n]})" for n in wanted)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
