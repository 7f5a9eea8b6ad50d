"""Typed bronze tables and their catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import coerce
from ..functions.names import REJECTED, TECHNICAL, col, data_columns
from ..functions.text import blank_to_null


def wide_integer_types(profile: DataFrame) -> DataFrame:
    """Profile types, with integers that need more than 64 bits marked as ``wide_integer``. A column with integers of
    more than 38 digits stays text: no type would keep them."""
    size = F.greatest(F.abs("min"), F.abs("max"))
    return profile.select("ordinal", "column", F.when((F.col("type") == "integer") & (size >= 9.9e37), "text")
                          .when((F.col("type") == "integer") & (size > 9.2e18), "wide_integer")
                          .otherwise(F.col("type")).alias("type"))


def cast_bronze(df: DataFrame, types: Mapping[str, str], keep_rejected: bool = False) -> DataFrame:
    """Raw text to typed columns; blanks become NULL, text is trimmed. Technical columns pass through.

    Dates stay text here (silver conforms them), so that rows are compared as they arrived. With
    ``keep_rejected`` a map column holds every value that did not fit the type of its column.
    """
    data = data_columns(df)
    # Trim in a projection of its own: each value is trimmed once, however often the casts look at it.
    raw = df.select(*[col(c).cast("string").alias(c) if c in data else col(c) for c in df.columns])
    text = raw.select(*[blank_to_null(c).alias(c) if c in data else col(c) for c in df.columns])
    out: list[Column] = []
    rejected: list[Column] = []
    for name in df.columns:
        if name in TECHNICAL:
            out.append(col(name))
            continue
        logical = types.get(name, "text")
        stored = "text" if logical in ("date", "datetime") else logical
        value = coerce(name, stored, trimmed=True)
        out.append(value.alias(name))
        if keep_rejected and stored != "text":
            rejected.append(F.when(col(name).isNotNull() & value.isNull(), F.struct(F.lit(name).alias("column"), col(name).alias("value"))))
    if keep_rejected:
        pairs = (F.array_compact(F.array(*rejected)) if rejected
                 else F.from_json(F.lit("[]"), "array<struct<column:string,value:string>>"))
        out.append(F.map_from_entries(pairs).alias(REJECTED))
    return text.select(*out)


def catalog_rows(profile: DataFrame, samples: DataFrame, pii: DataFrame, dims: DataFrame) -> DataFrame:
    """Catalog entries: the profile with samples, key flag, personal-data class and dimension flag per column. Personal
    data have no samples in the catalog."""
    key = ((F.col("rows") > 1) & (F.col("distinct") == F.col("rows")) & (F.col("nulls") == 0)
           & ~F.col("type").isin("real", "boolean"))
    return (profile.withColumn("is_key", key)
            .join(samples.select("column", "samples"), "column", "left")
            .join(pii.select("table", "column", F.col("class").alias("pii_class")), ["table", "column"], "left")
            .join(dims.select("table", "column", F.lit(True).alias("is_dimension")), ["table", "column"], "left")
            .withColumn("is_dimension", F.coalesce("is_dimension", F.lit(False)))
            .withColumn("samples", F.when(F.col("pii_class").isNull(), F.col("samples"))))


def attach_pii_flags(catalog: DataFrame, pii: DataFrame) -> DataFrame:
    """Look up the personal-data class of each catalog column by table and column name."""
    return catalog.join(pii.select("table", "column", F.col("class").alias("pii_class")), ["table", "column"], "left")
