"""Numbers of run reports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """Percent to two places, half to even; 0 where the whole is not positive."""
    return F.when(whole > 0, F.bround(part / whole * 100, 2)).otherwise(0.0)


def floored(c: Column) -> Column:
    """Nothing below 0."""
    return F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def skipped(found: Column, collected: Column) -> Column:
    return floored(found - collected)
