"""Scalar functions for filters and calculated columns.

Expressions are ordinary Spark SQL strings or Columns.  The functions here are those whose semantics
differ from Spark's built-ins; ``register`` makes none of them a Python UDF, they are all Column
compositions.  Results outside a function's domain are NULL, never NaN or an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The number, or NULL for NULL, NaN and infinities."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def isnum(x: Column) -> Column:
    """True for a finite number, else false."""
    return finite(x).isNotNull()


def ifnum(x: Column, default) -> Column:
    return F.coalesce(finite(x), F.lit(default).cast("double"))


def ifnull(x: Column, default) -> Column:
    """NULL or NaN give the default; infinities stay."""
    d = x.cast("double")
    return F.coalesce(F.when(F.isnan(d), None).otherwise(d), F.lit(default).cast("double"))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity: -2.5 gives -2."""
    f = float(10**digits)
    return F.floor(x * f + 0.5).cast("double") / f


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def least_of(*xs: Column) -> Column:
    """The smallest; NULL if any is NULL (Spark's least skips NULLs)."""
    return F.when(_any_null(xs), None).otherwise(F.least(*xs) if len(xs) > 1 else xs[0])


def greatest_of(*xs: Column) -> Column:
    return F.when(_any_null(xs), None).otherwise(F.greatest(*xs) if len(xs) > 1 else xs[0])


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x.isNull()
    return out


def clamp(x: Column, low, high) -> Column:
    return least_of(greatest_of(x, F.lit(low).cast("double")), F.lit(high).cast("double"))


def cap(x: Column, *limits) -> Column:
    """cap(x, high) or cap(x, low, high); NULL stays NULL."""
    low, high = (None, limits[0]) if len(limits) == 1 else limits
    capped = F.least(x, F.lit(high).cast("double"))
    return F.when(x.isNull(), None).otherwise(capped if low is None else F.greatest(capped, F.lit(low).cast("double")))


def between(x: Column, low, high) -> Column:
    """Inclusive; NULL gives false."""
    return F.coalesce(x.between(low, high), F.lit(False))


def differs(x: Column, y) -> Column:
    """Whether two values differ; true where one is NULL or NaN, as a comparison for equality is false there."""
    return ~F.coalesce(x == (y if isinstance(y, Column) else F.lit(y)), F.lit(False)) | F.coalesce(F.isnan(x.try_cast("double")), F.lit(False))


def remap(x: Column, mapping: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)).otherwise(out)
    return out


def sqrt(x: Column) -> Column:
    return finite(F.sqrt(x))


def power(x: Column, n) -> Column:
    return finite(F.pow(x, n if isinstance(n, Column) else F.lit(n)))


def asin(x: Column) -> Column:
    return finite(F.asin(x))


def acos(x: Column) -> Column:
    return finite(F.acos(x))


def truthy(x: Column, kind: str) -> Column:
    """Truth of a value by its type: 0, empty text, NULL and NaN are false."""
    if kind == "boolean":
        return F.coalesce(x, F.lit(False))
    if kind == "string":
        return F.coalesce(x, F.lit("")) != ""
    return ifnull(x, 0.0) != 0


PI, E = math.pi, math.e

# Coefficients of the usual rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def normal_score(p: Column) -> Column:
    """Inverse of the standard normal distribution; beyond 1e-10 of either end it is -1e10 or 1e10."""
    low = 0.02425
    q = p - 0.5
    middle = _poly(q * q, _A) * q / (_poly(q * q, _B) * q * q + 1.0)
    lower = F.sqrt(-2.0 * F.ln(p))
    upper = F.sqrt(-2.0 * F.ln(1.0 - p))
    tail = lambda t: _poly(t, _C) / (_poly(t, _D) * t + 1.0)
    return F.when(p <= 1e-10, -1e10).when(p >= 1 - 1e-10, 1e10).when(p < low, tail(lower)).when(p > 1 - low, -tail(upper)).otherwise(middle)
