"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, and a Hamming check of what shares blocks.

A fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits differ in at most three
blocks, so three blocks agree: each fingerprint is keyed by all 20 choices of three blocks (about 32 bits a key).
Only keys with two or more different fingerprints are gathered. A key held by many fingerprints is dealt into tiles
of bounded size, and every pair of tiles is one group; a group emits a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import durable
from .graph import EDGES, Forest, components, spanning_pairs

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BLOCK_WIDTHS = (11, 11, 11, 11, 10, 10)
TILE = 2048
_COUNT_CHUNK = 1 << 16
_PRINT = "__row_print__"


def fingerprint_of(raw: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text. ``bytes.lower`` and ``bytes.split`` know ASCII only, as asked."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[shingle - 1:])]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _COUNT_CHUNK):
        part = np.array(hashes[at:at + _COUNT_CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint_of(x or b"") for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _printed_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint_of(x or b"") for x in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["id", "print", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; ``fp`` is the fingerprint's 64 bits as a signed long."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _masks(widths: Iterable[int], agree: int) -> list[int]:
    blocks, low = [], 0
    for width in widths:
        blocks.append(((1 << width) - 1) << low)
        low += width
    masks = [sum(chosen) for chosen in combinations(blocks, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _near_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row holds the fingerprints of one key and pair of tiles; out come the edges of a spanning forest."""
    for batch in batches:
        forest = Forest()
        for members in batch.column(0):
            own = members.values.to_numpy(zero_copy_only=False).view(np.uint64)
            near = np.empty((len(own), len(own)), dtype=bool)
            for at in range(0, len(own), 256):
                near[at:at + 256] = np.bitwise_count(own[at:at + 256, None] ^ own[None, :]) <= MAX_BITS
            np.fill_diagonal(near, False)
            signed = own.view(np.int64).tolist()
            for i, j in spanning_pairs(near):
                forest.join(signed[i], signed[j])
        pairs = list(forest.stars())
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], ["src", "dst"])


def near_edges(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(src, dst) fingerprints that differ in at most ``MAX_BITS`` bits, enough of them to join every such pair.

    ``prints`` has one row per different fingerprint, in column ``fp``.
    """
    masks = _masks(BLOCK_WIDTHS, len(BLOCK_WIDTHS) - MAX_BITS)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                          .alias("block", "key"))
    shared = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    member = (keyed.join(shared, ["block", "key"])
              .withColumn("own", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))))
    groups = (member.groupBy("block", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
              .agg(F.collect_list("fp").alias("members")))
    return groups.select("members").mapInArrow(_near_batches, EDGES)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id that links reach from it.

    NULL and blank texts have fingerprint zero and link like any other. A row without doc_id gets the component its
    fingerprint belongs to; it is NULL if no row there has an id. Rows that repeat an id are each fingerprinted.
    Texts of any length are read whole. Empty tables give an empty table; other columns are not read.
    """
    stored = durable(fingerprints(docs, doc_id, text))
    classes = durable(stored.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    reached = components(near_edges(classes)).withColumnRenamed("node", "fp")
    linked = classes.join(reached, "fp")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = linked.join(least, "component").select("fp", "component_id")
    labels = (classes.join(found, "fp", "left")
              .select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    return stored.join(labels, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp="fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: exactly one row of each group of linked rows, all columns unchanged.

    Of a group the row with the smallest doc_id stays; rows without doc_id come last, equal ids are told apart by a
    hash of the whole row, and of rows equal in every column one stays. An id that repeats with different texts is
    two documents: each belongs to the group of its own fingerprint. NULL and blank texts are one group. An empty table
    gives an empty table; columns of any name may stand beside.
    """
    others = [F.col(quoted(c)) for c in docs.columns if c not in (doc_id, text)]
    marked = docs.withColumn(_PRINT, F.xxhash64(F.col(quoted(text)), F.to_json(F.struct(*others)) if others else F.lit(0)))
    rows = durable(marked.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.col(_PRINT).alias("print"),
                                 F.col(quoted(text)).cast("binary").alias("text"))
                   .mapInArrow(_printed_batches, "id long, print long, fp long"))
    # One row per fingerprint from here on: a fingerprint that a third of all rows hold is one row, made map-side.
    classes = durable(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "print")).alias("first")))
    groups = components(near_edges(classes)).withColumnRenamed("node", "fp")
    first = (classes.join(groups, "fp", "left").groupBy(F.coalesce("component", "fp").alias("group"))
             .agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id__"), F.col("first.print").alias("__first__")))
    staying = marked.join(first, F.col(quoted(doc_id)).eqNullSafe(F.col("__id__")) & (F.col(_PRINT) == F.col("__first__")), "left_semi")
    twice = rows.join(first, F.col("id").eqNullSafe(F.col("__id__")) & (F.col("print") == F.col("__first__")), "left_semi")
    if not twice.groupBy("id", "print").count().where("count > 1").isEmpty():
        staying = staying.dropDuplicates([doc_id, _PRINT])
    return staying.select(*[F.col(quoted(c)) for c in docs.columns])
