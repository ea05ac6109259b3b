"""Column helpers that the operators share: guarded windows, null-safe division and a few scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    """Bars of one ticker in order. Every ordered operator uses this window, so one exchange and sort serve them all."""
    return Window.partitionBy("Ticker").orderBy("Date")


def rolling(n: int) -> WindowSpec:
    return by_date().rowsBetween(-(n - 1), 0)


def guarded(agg, column: Column, n: int, min_periods: int | None = None) -> Column:
    """An aggregate over the last ``n`` bars, null until ``min_periods`` (default ``n``) values are there."""
    return F.when(F.count(column).over(rolling(n)) >= (n if min_periods is None else min_periods), agg(column).over(rolling(n)))


def mean(column: Column, n: int, min_periods: int | None = None) -> Column:
    return guarded(F.avg, column, n, min_periods)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_true(flag: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(flag, F.lit(False))


def lag(column: str, k: int = 1) -> Column:
    return F.lag(column, k).over(by_date())


def lead(column: str, k: int = 1) -> Column:
    return F.lead(column, k).over(by_date())


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def band_score(value: Column, low: float, high: float, comfort: float = 0.02) -> Column:
    """1 inside [low, high], falling to 0 linearly outside, over ``comfort`` times the value (of 1 at least)."""
    far = F.least(F.abs(value - low), F.abs(value - high))
    return F.when(value.between(low, high), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - far / (comfort * F.greatest(F.lit(1.0), F.abs(value)))))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) * 0.3989422804014327


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by the rational polynomial of Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = normal_pdf(x) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def true_range() -> Column:
    """Largest of High - Low and the moves from the last Close; the first bar has High - Low."""
    before = lag("Close")
    return F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - before), F.abs(F.col("Low") - before))
