"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table (a start and a stride from its name).
Shards take turns claiming the next free slot they prefer, until the table is full: slot counts differ by at most
one, and a shard that goes moves few slots of the others. A key is placed by one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 8191
SHARDS = 64
_HEX_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX_DIGITS], 16)


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. The table has a fixed size, whatever the data: ``slots`` must be a prime."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be named differently and be no more than the slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    at = [_number(f"{name}:start") % slots for name in shards]
    stride = [_number(f"{name}:stride") % (slots - 1) + 1 for name in shards]
    owner: list[int | None] = [None] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] is not None:
            at[shard] = (at[shard] + stride[shard]) % slots
        owner[at[shard]] = shard
    return owner


def lookup(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """(slot, shard): the table as rows, as many as it has slots."""
    slots = F.from_json(F.lit(json.dumps(list(owner))), "array<int>")
    return spark.range(1).select(F.posexplode(slots).alias("slot", "shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5, modulo the slots. A NULL key is placed like an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("long") % slots).cast("int")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def place(rows: DataFrame, key: str, shards: int | Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; columns of these names are replaced.

    Equal keys go to one shard, so the key must be one that no large group shares (an id, not a source). The table
    is broadcast: ``slots`` rows, whatever the data. Rows with a NULL key are placed like an empty key; repeated rows
    stay; an empty table gives an empty table.
    """
    names = shard_names(shards) if isinstance(shards, int) else list(shards)
    table = F.broadcast(lookup(rows.sparkSession, fill_table(names, slots)))
    return rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(table, "slot")


def write_shards(rows: DataFrame, key: str, path: str, shards: int | Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """One Parquet folder per shard. A rebalance splits a shard that is large into several files."""
    placed = place(rows, key, shards, slots).drop("slot")
    placed.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
