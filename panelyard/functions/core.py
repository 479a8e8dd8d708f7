"""Column expressions and window shorthands shared by all operators."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ColumnLike = str | Column
SERIES = ("entity", "variable")


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: ColumnLike) -> Column:
    """NaN and +-inf become NULL, so that Spark aggregates skip them."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(c: ColumnLike, lo: float | Column, hi: float | Column) -> Column:
    """Bound a value; NULL stays NULL (greatest/least would skip it)."""
    x = col(c)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, NULL where the denominator is zero or NULL."""
    d = col(den)
    return F.when(d != 0, col(num) / d)


def series(by: Sequence[str] = SERIES, order: str = "date") -> WindowSpec:
    """One time series per key, in date order."""
    return Window.partitionBy(*by).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def prior_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current row, itself excluded."""
    return w.rowsBetween(-n, -1)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def guarded(expr: Column, x: ColumnLike, frame: WindowSpec, minimum: int) -> Column:
    """expr where the frame holds at least ``minimum`` non-null values of x."""
    return F.when(F.count(col(x)).over(frame) >= minimum, expr)


def spread(c: ColumnLike, ddof: int) -> Column:
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    return F.stddev_samp(col(c)) if ddof else F.stddev_pop(col(c))


def compounded(r: ColumnLike, frame: WindowSpec) -> Column:
    """prod(1 + r) - 1 over a frame."""
    return F.expm1(F.sum(F.log1p(col(r))).over(frame))


def month_start(c: ColumnLike) -> Column:
    return F.trunc(col(c), "month")


def month_number(c: ColumnLike) -> Column:
    """Integer month counter, year * 12 + month."""
    return F.year(col(c)) * 12 + F.month(col(c))


def norm_cdf(c: ColumnLike) -> Column:
    """Standard normal cdf by the Abramowitz-Stegun 26.2.17 polynomial (error < 7.5e-8)."""
    x = col(c)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (
        0.319381530
        + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def add_columns(df: DataFrame, **exprs: Column) -> DataFrame:
    """withColumns with keyword names; expressions sharing a window share one sort."""
    return df.withColumns(exprs)


# Coefficients of Acklam's rational approximation of the normal quantile.
_PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def norm_ppf(c: ColumnLike) -> Column:
    """Standard normal quantile (relative error < 1.2e-9)."""
    p = col(c)
    q, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    middle = _poly(_PPF_A, q * q) * q / _poly(_PPF_B, q * q)
    low = _poly(_PPF_C, tail) / _poly(_PPF_D, tail)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, low).when(p > 1 - 0.02425, -low).otherwise(middle)
