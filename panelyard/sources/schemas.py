"""Explicit schemas of the tidy tables; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _s(spec: str) -> T.StructType:
    kinds = {
        "date": T.DateType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
        "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (p.split(":") for p in spec.split())])


TIDY = _s("date:date entity:string value:double variable:string source:string")
NORMALISED = _s(
    "date:date entity:string value:double variable:string source:string normalization:string "
    "base_variable:string normalization_origin:string lookback_observations:int min_observations:int"
)
FACTOR_RETURNS = _s("date:date factor:string value:double source:string")
MEMBERSHIP = _s("date:date entity:string factor:string weight:double source:string")
REGION_FACTORS = _s(
    "date:date region:string frequency:string currency:string variable:string value:double units:string source:string"
)
ANNUAL = _s("date:date year:int entity:string iso3:string variable:string value:double source:string")
EDGES = _s("snapshot:date edge_type:string src:string dst:string weight:double")
EVENTS = _s(
    "event_id:string event_date:date end_date:date label:string category:string subcategory:string "
    "severity:int countries_affected:string is_global:boolean tags:string"
)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A missing optional source is an empty table of the fixed schema."""
    return spark.createDataFrame([], schema)
