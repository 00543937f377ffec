"""Exact percentages. Integer arithmetic only, so no engine-dependent float rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def percent_half_up(part: Column, whole: Column) -> Column:
    """100*part/whole to 2 decimals, half up; null if either is null or whole is 0."""
    n, d = part.cast("bigint"), whole.cast("bigint")
    return F.when(d != 0, _div(n * 20000 + d, d * 2) / F.lit(100.0))


def ratio_half_even(part: Column, whole: Column, scale: int, decimals: int) -> Column:
    """scale*part/whole to ``decimals`` places, ties to even; null if whole is 0."""
    n, d = part.cast("bigint") * (scale * 10**decimals), whole.cast("bigint")
    q = _div(n, d)
    rest = n - q * d
    up = (rest * 2 > d) | ((rest * 2 == d) & (q % 2 == 1))
    return F.when(d != 0, (q + F.when(up, 1).otherwise(0)) / F.lit(float(10**decimals)))


def percent_half_even(part: Column, whole: Column) -> Column:
    """100*part/whole to 1 decimal."""
    return ratio_half_even(part, whole, 100, 1)
