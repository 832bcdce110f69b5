"""Scalar expressions shared by operators; all stay inside of generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def digitize(c: Column, cuts: Sequence[Column | float]) -> Column:
    """Number of cuts at or below the value: right-open classes from 0."""
    return sum((F.when(c >= x, 1).otherwise(0) for x in cuts), F.lit(0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


#: Fixed values of a Chebyshev fit of the complementary error function, within 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative value."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for a in reversed(ERFC[:-1]):
        poly = a + t * poly
    return t * F.exp(-x * x + poly)
