"""Date recognition and normalization.

A value whose shape fits is rearranged to ISO order and cast; ``try_cast`` then rejects days that do not exist.
``25/03/2024`` falls through from day-first to month-first only because there is no month 25.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _as_column, blank_to_null, strip

# Accepted formats in order of precedence, as (shape, ISO rearrangement).
YEAR_FIRST = (r"^(?!0000)(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4")  # 2024-01-31, 2024/1/31
DAY_FIRST = (r"^(\d{1,2})([-/])(\d{1,2})\2(?!0000)(\d{4})$", "$4-$3-$1")  # 31/01/2024, 31-1-2024
MONTH_FIRST = (r"^(\d{1,2})/(\d{1,2})/(?!0000)(\d{4})$", "$3-$1-$2")  # 01/31/2024
COMPACT = (r"^(?!0000)(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")  # 20240131
DATE_FORMATS = (YEAR_FIRST, DAY_FIRST, MONTH_FIRST, COMPACT)

# 2024-01-31 10:20:30, 2024-01-31T10:20:30, 2024-01-31T10:20:30Z
DATETIME_SHAPE = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{1,2}:\d{1,2}|T\d{1,2}:\d{1,2}:\d{1,2}Z?)$"


def trimmed_date(value: Column, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """Date of text without outer blanks, NULL if no format fits."""
    return F.coalesce(*[F.when(value.rlike(shape), F.regexp_replace(value, shape, iso).try_cast("date"))
                        for shape, iso in formats])


def trimmed_datetime(value: Column) -> Column:
    """Timestamp of text without outer blanks, in the session time zone; NULL if no format fits."""
    return F.when(value.rlike(DATETIME_SHAPE), F.rtrim(value, F.lit("Z")).try_cast("timestamp"))


def parse_datetime(c: Column | str) -> Column:
    return trimmed_datetime(strip(c))


def parse_date(c: Column | str, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """Date of the first format that fits, or of a timestamp, else NULL."""
    value = strip(c)
    return F.coalesce(trimmed_date(value, formats), trimmed_datetime(value).cast("date"))


def norm_date(c: Column | str, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """ISO day of any recognized date or timestamp; other text as it is (trimmed); blank is NULL."""
    return F.coalesce(parse_date(c, formats).cast("string"), blank_to_null(c))


def is_date(c: Column | str) -> Column:
    return trimmed_date(_as_column(c)).isNotNull()


def is_datetime(c: Column | str) -> Column:
    return trimmed_datetime(_as_column(c)).isNotNull()
