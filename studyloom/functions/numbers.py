"""Numeric conventions: three ways to round, splits and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def half_up(c: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("long")


def even_split(total: Column, parts: Column) -> Column:
    """An array of `parts` whole numbers that sum to total and differ by one at most, larger ones first."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.floor(total / parts).cast("long") + F.when(i < total % parts, 1).otherwise(0))
