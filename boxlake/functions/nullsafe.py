"""Null-honest arithmetic: a missing or zero denominator gives null, never an error or infinity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sdiv(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or either is null. One expression: guards that repeat b make methods too long for the JVM to compile."""
    return F.try_divide(a, b)


def positive(x: Column) -> Column:
    """x if it is over 0, else null (minutes and possessions that are not over 0 are missing)."""
    return F.when(x > 0, x)


def finite(x: Column) -> Column:
    """x as a double; NaN and infinities are null."""
    y = x.cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def zero_if(condition: Column, x: Column) -> Column:
    return F.when(condition, F.lit(0.0)).otherwise(x)
