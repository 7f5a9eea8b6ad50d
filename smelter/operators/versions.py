"""Versioning of keyed tables by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.text import content_hash

STORE_COLUMNS = ("version", "content_hash", "changelog")


def version_diff(previous: DataFrame | None, current: DataFrame, key: str) -> DataFrame:
    """Compare a keyed table with its previous version store.

    ``status`` is created, unchanged, changed or removed. A created row is version 1; a changed one gets the
    next version and one more changelog entry; an unchanged one keeps both. ``previous`` is an earlier result
    of this function, or a plain earlier snapshot, whose rows then count as version 1. NULL is a key like any other.
    A key that repeats on either side raises: its rows could not be told apart.
    """
    for side, df in (("current", current), ("previous", previous)):
        if df is not None:
            live = df.where(F.col("status") != "removed") if "status" in df.columns else df
            repeated = live.groupBy(col(key)).count().where("count > 1").first()
            if repeated is not None:
                raise ValueError(f"key {repeated[0]!r} repeats in the {side} table")
    body = [c for c in current.columns if c not in (*STORE_COLUMNS, "status", key)]
    entry = "array<struct<version:int,change:string>>"
    created = F.array(F.struct(F.lit(1).alias("version"), F.lit("created").alias("change"))).cast(entry)
    now = current.select(col(key), *[col(c) for c in body], content_hash([key, *body]).alias("_hash"),
                         F.lit(True).alias("_now"))
    if previous is None:
        return now.select(col(key), *[col(c) for c in body], F.lit("created").alias("status"),
                          F.lit(1).alias("version"), created.alias("changelog"),
                          F.col("_hash").alias("content_hash"))
    old = previous
    if "version" not in old.columns:
        old = (old.withColumn("content_hash", content_hash([key, *body]))
               .withColumn("version", F.lit(1)).withColumn("changelog", created))
    elif "status" in old.columns:
        old = old.where(F.col("status") != "removed")
    old = old.select(col(key).alias("_key"), F.col("content_hash").alias("_old_hash"),
                     F.col("version").cast("int").alias("_old_version"), F.col("changelog").cast(entry).alias("_log"), F.lit(True).alias("_then"))
    both = now.join(old, F.col("_key").eqNullSafe(col(key)), "full_outer")
    status = (F.when(F.col("_then").isNull(), "created").when(F.col("_now").isNull(), "removed")
              .when(F.col("_hash") == F.col("_old_hash"), "unchanged").otherwise("changed"))
    following = F.col("_old_version") + 1
    bumped = F.concat("_log", F.array(F.struct(following.alias("version"),
                                               F.lit("definition changed").alias("change"))).cast(entry))
    return (both.withColumn("status", status)
            .select(F.coalesce(col(key), F.col("_key")).alias(key), *[col(c) for c in body], "status",
                    F.when(F.col("status") == "created", 1).when(F.col("status") == "changed", following)
                    .otherwise(F.col("_old_version")).alias("version"),
                    F.when(F.col("status") == "created", created).when(F.col("status") == "changed", bumped)
                    .otherwise(F.col("_log")).alias("changelog"),
                    F.coalesce("_hash", "_old_hash").alias("content_hash")))
