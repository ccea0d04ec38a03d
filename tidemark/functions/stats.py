"""Ratios, intervals and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def ratio(num: Column, den: Column, places: int = 4) -> Column:
    """Rounded share; null where the denominator is 0."""
    return F.round(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")), places)


def f1(p: Column, r: Column, places: int = 4) -> Column:
    """Harmonic mean; 0 where both are 0, null where one is null."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), places))


def wilson(k: Column, n: Column, places: int = 4) -> tuple[Column, Column]:
    """95 % score interval, clamped to [0, 1]; null for n = 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = k.cast("double") / m
    base = 1 + Z95 * Z95 / m
    middle = (p + Z95 * Z95 / (2 * m)) / base
    half = Z95 * F.sqrt(p * (1 - p) / m + Z95 * Z95 / (4 * m * m)) / base
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(m.isNotNull(), F.round(low, places)), F.when(m.isNotNull(), F.round(high, places))


def gap_bin(gap: Column) -> Column:
    """Gaps of scorers: 0 (and below) apart from 1-4."""
    return (
        F.when(gap <= 0, "0").when(gap <= 4, "1-4").when(gap <= 29, "5-29").when(gap >= 30, ">=30")
    )


def manifest_bin(gap: Column) -> Column:
    """Gaps of the manifest histogram: 0 falls in 1-4."""
    return F.when(gap <= 4, "1-4").when(gap <= 29, "5-29").when(gap >= 30, ">=30")


def lower_quantile(ordered: Column, share: float) -> Column:
    """Element at floor(share * (n - 1)) of a sorted array; null for an empty one."""
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.floor(share * (n - 1)).cast("int")))


def upper_median(ordered: Column) -> Column:
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over non-null values; a null or zero weight counts as 1. An aggregate."""
    w = F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0))
    return F.sum(value * w) / F.nullif(F.sum(F.when(value.isNotNull(), w)), F.lit(0.0))
