"""Exact top-k by inner product, with a table of distances to pivots.

For any pivot p, |x - y| >= | |x-p| - |y-p| |, so x.y <= (|x|^2 + |y|^2 - bound^2) / 2 with the largest of these lower
bounds. Every vector carries its distances to the same pivots. Queries and candidates are dealt into blocks of bounded
size; each pair of blocks scores candidates in the order of their upper bounds until no bound reaches the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .vectors import finite, matrix

PIVOTS = 16
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
_FIRST_STEP = 64
_QUERIES_AT_ONCE = 32
_EXACT = float(1 << 53)
_LONG_MAX = (1 << 63) - 1


def _distances(pivots: list[list[float]]):
    """Any point can be a pivot: for vectors of another length it is repeated or cut to that length."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector"))
            out = []
            for x in lists.to_pylist():
                v = np.array(x)
                out.append([float(np.sqrt(((v - np.resize(np.array(p), len(v))) ** 2).sum())) for p in pivots])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))],
                                             [*batch.schema.names, "table"])

    def run_even(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector"))
            lengths = np.unique(np.diff(lists.offsets.to_numpy()))
            if len(lengths) != 1:
                yield from run([batch])
                continue
            x = matrix(lists)
            out = np.stack([np.sqrt(((x - np.resize(np.array(p), x.shape[1])) ** 2).sum(axis=1)) for p in pivots], axis=1)
            table = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots)),
                                             pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, table], [*batch.schema.names, "table"])
    return run_even


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: doubles where they hold every partial sum, whole numbers beyond."""
    if not len(x) or np.abs(x).max() * np.abs(q).max() * len(q) < _EXACT:
        return np.rint(x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    sums = [sum(int(a) * b for a, b in zip(row, whole)) for row in x]
    return np.array([min(max(s, -_LONG_MAX), _LONG_MAX) for s in sums], dtype=np.int64)


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, upper: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one block, highest first, smaller ids first among equals."""
    order = np.argsort(-upper, kind="stable")
    ids_kept, kept, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, _FIRST_STEP
    while at < len(order):
        if len(kept) == k and upper[order[at]] < kept[-1]:
            break
        part = order[at:at + step]
        if len(kept) == k:
            part = part[upper[part] >= kept[-1]]
        part = part[ids[part] != own]
        score, name = np.concatenate([kept, _scores(x[part], q)]), np.concatenate([ids_kept, ids[part]])
        first = np.lexsort((name, -score))[:k]
        kept, ids_kept = score[first], name[first]
        at, step = at + step, step * 4
    return list(zip(kept.tolist(), ids_kept.tolist()))


def _block_pair(k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, prints = rows.column("vec_id").to_numpy(), rows.column("print").to_numpy()
        vectors, table = matrix(rows.column("vector")), matrix(rows.column("table"))
        squared = (vectors ** 2).sum(axis=1)
        queries, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
        x, x_ids, x_table, x_squared = vectors[rest], ids[rest], table[rest], squared[rest]
        found: list[tuple[int, int, int, int]] = []
        for at in range(0, len(queries) if len(rest) else 0, _QUERIES_AT_ONCE):
            some = queries[at:at + _QUERIES_AT_ONCE]
            apart = np.zeros((len(some), len(rest)))
            for p in range(table.shape[1]):
                np.maximum(apart, np.abs(table[some, p][:, None] - x_table[None, :, p]), out=apart)
            total = squared[some][:, None] + x_squared[None, :]
            upper = (total - apart * apart) / 2 + total * 1e-9 + 1e-6  # more than rounding can take away
            for row, i in enumerate(some):
                best = _best(x, x_ids, vectors[i], ids[i], upper[row], k)
                found += [(int(ids[i]), int(prints[i]), name, score) for score, name in best]
        columns = list(zip(*found)) if found else [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "print", "vec_id", "score"), columns)})
    return run


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, vector, print): components as floor(scale * x). Rows that repeat an id and vector count once."""
    vector = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    return (rows.where(F.col(vec_id).isNotNull() & finite(F.col(embedding)))
            .select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector")).distinct()
            .withColumn("print", F.xxhash64("vector")))


def top_k(rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: float = 256.0, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds (a condition on ``vec_id``), the ``k``
    rows of another id with the highest integer inner products, ties to the smaller id.

    Components are floor(scale * x). Vectors that are NULL, empty, or hold NULL or non-finite components take no
    part; neither do rows without id, nor pairs of different lengths. Rows equal in id and vector count once. A query
    id that repeats with different vectors is answered for each. Scores beyond a long are held at its ends. A query
    without candidates, and an empty table, give no rows.
    """
    stored = durable(integer_vectors(rows, vec_id, embedding, scale))
    chosen = [r[0] for r in stored.orderBy("print", "vec_id").limit(pivots).select("vector").collect()]
    sizes = stored.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    if not chosen or not sizes[1]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_blocks, c_blocks = -(-sizes[1] // query_block), -(-sizes[0] // candidate_block)
    tabled = (stored.mapInArrow(_distances(chosen), "vec_id long, vector array<double>, print long, table array<double>")
              .withColumn("dim", F.size("vector")))

    def to_all(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one_of(n: int):
        return F.pmod(F.xxhash64("vec_id", "print"), F.lit(n)).cast("int")

    asked = (tabled.where(is_query).withColumn("asks", F.lit(True)).withColumn("q", one_of(q_blocks))
             .withColumn("c", to_all(c_blocks)))
    offered = tabled.withColumn("asks", F.lit(False)).withColumn("c", one_of(c_blocks)).withColumn("q", to_all(q_blocks))
    found = (asked.unionByName(offered).groupBy("dim", "q", "c")
             .applyInArrow(_block_pair(k), "query_id long, print long, vec_id long, score long"))
    ranked = W.partitionBy("query_id", "print").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
