"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def safe_div(x: Column, y: Column, default: float = 0.0) -> Column:
    """X / y as double, ``default`` when y is 0 or null (ANSI-safe: the
    division branch is not evaluated for a zero divisor)."""
    return F.when(y.isNull() | (y == 0), F.lit(default)).otherwise(x.cast("double") / y.cast("double"))


def r6(c: Column) -> Column:
    """Round a double to the precision used for cross-engine comparison."""
    return F.round(c.cast("double"), DIGITS)
