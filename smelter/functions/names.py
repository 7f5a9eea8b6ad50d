"""Column and table names (driver side; these never touch rows)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"
SOURCE_FILE = "_source_file"
CORRUPT = "_corrupt_record"
REJECTED = "_rejected"
TECHNICAL = (ROW_ID, SOURCE_FILE, CORRUPT, REJECTED)


def quoted(name: str) -> str:
    """Back-quote a column name so that dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def data_columns(df: DataFrame) -> list[str]:
    """Columns that carry source data, without the technical ones added at landing."""
    return [c for c in df.columns if c not in TECHNICAL]


def table_ident(stem: str, taken: Iterable[str] = ()) -> str:
    """Turn a file stem into a table name: lower case, ``_`` for other characters, unique among ``taken``."""
    name = re.sub(r"[\W]", "_", stem).strip("_").lower()
    if not name or name[0].isdigit():
        name = f"t_{name}"
    used = set(taken)
    while name in used:
        name += "_x"
    return name


def label_from_id(ident: str) -> str:
    return ident.replace("_", " ").title()
