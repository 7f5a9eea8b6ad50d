"""De-duplication over a stream: the first row of each key wins, across micro-batches and restarts.

Each micro-batch keeps its own first rows, leaves out the keys that earlier batches hold, and writes the rest to a folder
named after the batch. Earlier batches only are looked at, so a batch that is written again after a failure finds what it
found the first time and replaces exactly itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, SOURCE_FILE, col
from ..operators.silver import dedupe_first
from .daily_fact import BATCH


def _new_only(first: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the stored ones; NULL is a key like any other. Only key columns of the store are read."""
    seen = stored.select(*[col(k).alias(f"_seen{i}") for i, k in enumerate(keys)])
    same = reduce(Column.__and__, [col(k).eqNullSafe(F.col(f"_seen{i}")) for i, k in enumerate(keys)])
    return first.join(seen, same, "left_anti")


def dedupe_stream(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str,
                  order: Sequence[str | Column] = (SOURCE_FILE, ROW_ID), remember: int | None = None,
                  continuous: str | None = None):
    """Write the first row of each key below ``path``; :func:`first_rows` reads them. Returns the streaming query.

    A key's row comes from the first batch that holds the key, and within it from the first row in ``order``. If arrivals
    follow ``order`` the result is that of ``dedupe_first`` over all rows. By default every key is known for ever; with
    ``remember`` only the keys that the last so many batches wrote are, which bounds the work of an endless stream, and a
    key that comes again later starts anew. By default everything available is processed, then the query stops;
    ``continuous`` is a trigger interval such as ``"1 minute"``. A column named ``_batch`` is refused.
    """
    if not keys:
        raise ValueError("name the columns that make a key")
    if BATCH in {c.lower() for c in stream.columns}:
        raise ValueError(f"the name {BATCH} is taken by the batches' folders")

    def write(batch: DataFrame, number: int) -> None:
        first = dedupe_first(batch, keys, order)
        if number:
            earlier = F.col(BATCH) < number
            if remember is not None:
                earlier = earlier & (F.col(BATCH) >= number - remember)
            first = _new_only(first, batch.sparkSession.read.parquet(f"{path}/first").where(earlier), keys)
        first.write.mode("overwrite").parquet(f"{path}/first/{BATCH}={number}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def first_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that all batches so far have kept."""
    return spark.read.parquet(f"{path}/first").drop(BATCH)
