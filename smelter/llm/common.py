"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from. A NULL id is in no fold: never held out, never learned from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside it, the value is a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fraction_below(key: Column, share: Column) -> Column:
    """True for about ``share`` of all keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < (share * (1 << 30)).cast("long")


class Kept:
    """Answers a worker keeps, at most ``2 * size`` of them: when the young ones are full they become the old ones, and an
    old one that is asked for is young again."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def from_old(self, key):
        """The value of a key that is not among the young ones, or None."""
        value = self.old.get(key)
        return None if value is None else self.put(key, value)
