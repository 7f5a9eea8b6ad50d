"""Sinks, and gold that somebody else built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Overwrite a Parquet table and return it as read back, so that later steps start from the stored rows.

    With partition columns the rows are rebalanced on them first: small partitions share a task, and a
    partition that holds a large share of the rows is split over several.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """A supplied gold table."""
    return spark.read.parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    """Answers, panels and metric definitions for readers outside Spark."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def upsert_stage(df: DataFrame, path: str, key: str = "stage") -> None:
    """Append audit rows; rows an earlier run wrote for the same stage are replaced, other stages stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))
