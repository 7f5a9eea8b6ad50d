"""Silver: cleaned, conformed, de-duplicated rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, SOURCE_FILE, TECHNICAL, col, data_columns
from ..functions.casts import coerce
from ..functions.text import blank_to_null


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = (SOURCE_FILE, ROW_ID)) -> DataFrame:
    """Keep the first row per key in the given order; NULL keys are equal.

    Spark limits each key to one row per task before the shuffle, so a key that holds a large share of the
    table does not end up in one task. Give an order without ties for a repeatable result.
    """
    ordering = [col(o) if isinstance(o, str) else o for o in order]
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*[col(k) for k in keys]).orderBy(*ordering)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def dedupe_all(df: DataFrame) -> DataFrame:
    """Drop exact duplicates over the data columns; of the technical columns the smallest values are kept."""
    kept = [c for c in df.columns if c in (SOURCE_FILE, ROW_ID)]
    if not kept:
        return df.dropDuplicates(data_columns(df))
    first = F.min(F.struct(*[col(c) for c in kept])).alias("_first")
    data = data_columns(df)
    return df.groupBy(*[col(c) for c in data]).agg(first).select(*[col(c) for c in data], "_first.*")


def _clean(name: str, logical: str) -> Column:
    if logical == "text":
        return blank_to_null(name).alias(name)
    if logical in ("date", "datetime"):  # bronze has trimmed them
        return coerce(name, logical, trimmed=True).alias(name)
    return col(name)


def clean_silver(bronze: DataFrame, types: Mapping[str, str], keys: Sequence[str] = (),
                 order: Sequence[str] = (SOURCE_FILE, ROW_ID)) -> DataFrame:
    """De-duplicate on the keys (on all columns if there are none), then conform dates and blanks."""
    present = [c for c in order if c in bronze.columns]
    rows = dedupe_first(bronze, keys, present) if keys and present else (
        bronze.dropDuplicates(list(keys)) if keys else dedupe_all(bronze))
    return rows.select(*[_clean(c, types.get(c, "text")) for c in data_columns(rows)],
                       *[col(c) for c in rows.columns if c in TECHNICAL])


def dedupe_receipt(bronze: DataFrame, silver: DataFrame, table: str) -> DataFrame:
    """Row counts before and after, as a quality row."""
    before = bronze.agg(F.count(F.lit(1)).alias("n")).select(F.lit("bronze").alias("side"), "n")
    after = silver.agg(F.count(F.lit(1)).alias("n")).select(F.lit("silver").alias("side"), "n")
    counts = before.unionByName(after).groupBy().agg(
        F.sum(F.when(F.col("side") == "bronze", F.col("n"))).alias("bronze_rows"),
        F.sum(F.when(F.col("side") == "silver", F.col("n"))).alias("silver_rows"))
    return counts.select(F.lit(table).alias("table"), "bronze_rows", "silver_rows",
                         (F.col("bronze_rows") - F.col("silver_rows")).alias("dropped"), F.lit("pass").alias("result"))
