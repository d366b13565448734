"""Rounding, units and number formatting."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MM = 72 / 25.4  #: points in a millimetre


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x + 0.5)


def places(x: Column, n: int = 1) -> Column:
    return half_up(x * 10**n) / float(10**n)


def plain(x: Column) -> Column:
    """A double as text, without a decimal point if it is whole."""
    x = x.cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def mm(points: Column) -> Column:
    return points / MM


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def number_or(text: Column, default: Column | float) -> Column:
    """A setting given as text: kept if it is a finite number of 0 or more; '' counts as 0."""
    value = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    fine = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(fine, value).otherwise(F.lit(default) if isinstance(default, float | int) else default)
