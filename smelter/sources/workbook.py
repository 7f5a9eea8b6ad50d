"""Excel workbooks: the first worksheet as text columns. Workbooks are read in parallel, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, SOURCE_FILE

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - 64
    return number - 1


def _sheet_rows(content: bytes):
    """Rows of the first worksheet. A cell goes where its reference says, so blank cells shift nothing."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = book.namelist()
        texts: list[str] = []
        if "xl/sharedStrings.xml" in parts:
            for item in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si"):
                texts.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheets = sorted((p for p in parts if p.startswith("xl/worksheets/sheet")), key=lambda p: (len(p), p))
        if not sheets:
            raise ValueError("no worksheet found in the workbook")
        with book.open(sheets[0]) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for place, cell in enumerate(row.findall(f"{_MAIN}c")):
                    at = _column_number(cell.get("r", "")) if cell.get("r") else place
                    value = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "s" and value is not None:
                        cells[at] = texts[int(value)]
                    elif cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    else:
                        cells[at] = value or ""
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()


def _workbook_rows(batches):
    import pandas as pd

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            pending: list[tuple[str, int, list[str]]] = []
            for number, cells in enumerate(_sheet_rows(content)):
                pending.append((path, number, cells))
                if len(pending) == 10_000:
                    yield pd.DataFrame(pending, columns=["path", "number", "cells"])
                    pending = []
            if pending:
                yield pd.DataFrame(pending, columns=["path", "number", "cells"])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The header row names the columns (``col_<i>`` where blank); short rows are padded with blanks."""
    rows = (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInPandas(_workbook_rows, "path string, number long, cells array<string>"))
    try:
        first = rows.where(F.col("number") == 0).limit(1).collect()
    except Exception as error:  # a damaged workbook surfaces as a task failure
        raise ValueError(f"unreadable workbook: {error}") from error
    if not first:
        raise ValueError("the worksheet is empty")
    header = [h or f"col_{i}" for i, h in enumerate(first[0]["cells"])]
    place = {name: i for i, name in enumerate(header)}  # of a repeated name the last column counts
    return (rows.where(F.col("number") > 0)
            .select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(name) for name, i in place.items()],
                    F.col("path").alias(SOURCE_FILE), F.col("number").alias(ROW_ID)))
