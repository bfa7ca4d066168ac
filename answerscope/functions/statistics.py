"""Aggregate expressions that drop incomplete pairs and never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null where a side is constant or empty.

    The ``regr_*`` sums skip incomplete pairs themselves. ``corr`` would raise
    a division by zero on a constant column in ANSI mode.
    """
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)))


def to_number(value: Column) -> Column:
    """Numbers that parse; anything else, NaN included, becomes null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def half_even(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)
