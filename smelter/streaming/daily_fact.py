"""Incremental refresh of a daily fact from a stream of silver rows.

Each micro-batch is aggregated on its own, as the batch fact would be, and writes its sums to a folder named after the
batch: writing a batch again after a failure replaces exactly that batch. The current fact adds the batches up. Sums
and counts add in any order, so a row counts whenever it arrives: nothing is late, and rows without a time stay a group
as in the batch fact. Compaction folds all batches so far into one table; later reads take the newest such table and
the batches after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from ..operators.gold import build_daily_fact

BATCH = "_batch"
UPTO = "_upto"


def refresh_fact_from_stream(stream: DataFrame, ts: str, dims: Sequence[str], measures: Sequence[str], name: str,
                             path: str, checkpoint: str, continuous: str | None = None):
    """Write the daily sums of each micro-batch below ``path``. By default everything available is processed, then the
    query stops; ``continuous`` is a trigger interval such as ``"1 minute"``. Returns the streaming query."""
    def write(batch: DataFrame, number: int) -> None:
        sums = build_daily_fact(batch, ts, dims, measures, name)
        sums.write.mode("overwrite").parquet(f"{path}/batches/{BATCH}={number}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest compacted table with the batches after it, and the number of the last batch."""
    log = spark.read.parquet(f"{path}/batches")
    last = log.agg(F.max(BATCH)).first()[0]
    try:
        compacted = spark.read.parquet(f"{path}/compact")
    except AnalysisException:  # nothing compacted yet
        return log.drop(BATCH), last
    upto = compacted.agg(F.max(UPTO)).first()[0]
    newer = log.where(F.col(BATCH) > upto).drop(BATCH)
    return compacted.where(F.col(UPTO) == upto).drop(UPTO).unionByName(newer), max(last, upto)


def _added_up(parts: DataFrame, day: str, dims: Sequence[str]) -> DataFrame:
    values = [c for c in parts.columns if c not in (day, *dims)]
    return (parts.groupBy(col(day), *[col(d) for d in dims])
            .agg(*[F.sum(col(v)).alias(v) for v in values]))


def current_fact(spark: SparkSession, path: str, day: str, dims: Sequence[str]) -> DataFrame:
    """The fact over all batches written so far."""
    return _added_up(_parts(spark, path)[0], day, dims)


def compact_fact(spark: SparkSession, path: str, day: str, dims: Sequence[str]) -> int:
    """Fold all batches so far into one table and return the last one's number. Readers see the table once it is
    whole; batches that are folded in are not read any more and may be archived."""
    parts, last = _parts(spark, path)
    _added_up(parts, day, dims).write.mode("overwrite").parquet(f"{path}/compact/{UPTO}={last}")
    return last
