"""Predicates on values and on column names."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _as_column

# What counts as a number, an e-mail address, a phone number, a truth value.
INTEGER_TEXT = r"^[+-]?\d+$"
REAL_TEXT = r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"
EMAIL_TEXT = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_TEXT = r"^\+?\d[\d\s\-]{7,}\d$"
TRUE_TOKENS = ("true", "yes", "y", "t", "1")
FALSE_TOKENS = ("false", "no", "n", "f", "0")
WORD_TOKENS = ("true", "false", "yes", "no", "y", "n", "t", "f")

# Personal-data classes by column name; the first class that fits wins.
# The short identifiers `ssn` and `pan` must stand alone, so that `company` is not one of them.
PII_NAME_PATTERNS = {
    "email": r"e[-_]?mail",
    "phone": r"phone|mobile|msisdn|contact_no",
    "name": r"(full|first|last|customer|user)[_ ]?name|^name$",
    "address": r"address|street|pincode|zip|postal",
    "id": r"aadhaar|(^|[^a-z])(ssn|pan)([^a-z]|$)|passport|national[_ ]?id",
}

# Names of identifiers. A numeric column named so is not summed.
ID_NAME_PATTERN = r"(^|_)(id|key|code|no|num|number|uuid|guid)($|_)|id$|key$|number$"


def is_integer_text(c: Column | str) -> Column:
    return _as_column(c).rlike(INTEGER_TEXT)


def is_real_text(c: Column | str) -> Column:
    return _as_column(c).rlike(REAL_TEXT)


def is_email(c: Column | str) -> Column:
    return _as_column(c).rlike(EMAIL_TEXT)


def is_phone(c: Column | str) -> Column:
    return _as_column(c).rlike(PHONE_TEXT)


def is_id_like(name: Column | str, pattern: str = ID_NAME_PATTERN) -> Column:
    """On a column that holds column names."""
    return _as_column(name).rlike(f"(?i){pattern}")


def id_like_name(name: str, pattern: str = ID_NAME_PATTERN) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None


def pii_class_of_name(name: Column | str, patterns: Mapping[str, str] = PII_NAME_PATTERNS) -> Column:
    """Personal-data class of a column name, NULL if none fits. On a column that holds column names."""
    ref = _as_column(name)
    return F.coalesce(*[F.when(ref.rlike(f"(?i){pattern}"), F.lit(cls)) for cls, pattern in patterns.items()])


def pii_class_for(name: str, patterns: Mapping[str, str] = PII_NAME_PATTERNS) -> str | None:
    for cls, pattern in patterns.items():
        if re.search(pattern, name, re.IGNORECASE):
            return cls
    return None
