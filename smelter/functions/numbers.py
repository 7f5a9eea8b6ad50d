"""Ratios, rounding and display of metric values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _as_column


def null_safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded_total(c: Column | str, places: int = 6) -> Column:
    """Aggregate: the sum, 0 over no rows, rounded."""
    return F.round(F.coalesce(F.sum(_as_column(c)), F.lit(0)), places)


def round_metric(value: Column, places: int | None) -> Column:
    return value if places is None else F.round(value, places)


def format_metric(c: Column | str) -> Column:
    """Text of a metric value: thousands separated; two decimals at most, and none from 1,000 up."""
    value = _as_column(c).cast("double")
    fine = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
    return F.when(F.abs(value) < 1000, fine).otherwise(F.format_number(value, 0))
