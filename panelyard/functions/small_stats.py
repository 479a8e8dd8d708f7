"""Distribution helpers for pandas batches (no external statistics package)."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if not (f == f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return f_tail(t * t, 1, df)


def _f_batch(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else f_tail(float(x), float(a), float(b)) for x, a, b in zip(f, d1, d2)], dtype="float64")


def _t_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else t_two_sided(float(x), float(d)) for x, d in zip(t, df)], dtype="float64")


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return F.pandas_udf(_f_batch, DoubleType())(f, d1, d2)


def t_pvalue(t: Column, df: Column) -> Column:
    return F.pandas_udf(_t_batch, DoubleType())(t, df)
