"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(seconds: Column, width: int) -> Column:
    """Number of the bucket; floor division, so negative seconds go to negative buckets."""
    return F.floor(seconds / F.lit(width)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def quotient(part: Column, whole: Column) -> Column:
    """part / whole; NaN, not an error, where both are 0, as SQL engines with IEEE division have it."""
    return F.when(whole == 0, F.lit(math.nan)).otherwise(part / whole)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def surplus(a: Column, b: Column) -> Column:
    """a - b where positive, else 0."""
    return F.greatest(a - b, F.lit(0.0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))


def phase(position: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of the place within a period."""
    angle = F.lit(2 * math.pi) * (position % period) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(text))
