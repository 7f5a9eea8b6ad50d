"""Text to typed values. ANSI casts raise, so every cast here is a ``try`` cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import trimmed_date, trimmed_datetime
from .predicates import FALSE_TOKENS, TRUE_TOKENS
from .text import _as_column, blank_to_null

# Logical type -> Spark type of the column stored for it.
SPARK_TYPES = {
    "integer": "bigint",
    "wide_integer": "decimal(38,0)",
    "real": "double",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp",
    "text": "string",
}


def coerce(c: Column | str, logical_type: str, trimmed: bool = False) -> Column:
    """Cast text to the logical type; blank or unfit values are NULL. ``trimmed`` text has no blanks to remove."""
    value = _as_column(c) if trimmed else blank_to_null(c)
    if logical_type == "integer":
        # "3.0" and "1e3" also name integers; the fractional part is cut off.
        return (F.when(value.rlike("[.eE]"), value.try_cast("double").try_cast("bigint"))
                .otherwise(value.try_cast("bigint")))
    if logical_type == "wide_integer":
        return value.try_cast("decimal(38,0)")
    if logical_type == "real":
        return value.try_cast("double")
    if logical_type == "boolean":
        token = F.lower(value)
        return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)
    if logical_type == "date":
        return F.coalesce(trimmed_date(value), trimmed_datetime(value).cast("date"))
    if logical_type == "datetime":
        return trimmed_datetime(value)
    if logical_type == "text":
        return value
    raise ValueError(f"unknown logical type {logical_type!r}")


def numeric_or_zero(c: Column | str) -> Column:
    """A number for feature building: 0.0 when missing or not numeric."""
    return F.coalesce(_as_column(c).try_cast("double"), F.lit(0.0))
