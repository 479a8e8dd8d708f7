"""Registered queries: each pairs a Spark plan over the given tables with oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Query, Tables, _REGISTRY


def load_all() -> dict[str, Query]:
    from . import all_modules  # noqa: F401  (importing registers)

    return dict(_REGISTRY)


__all__ = ["Query", "Tables", "load_all"]
