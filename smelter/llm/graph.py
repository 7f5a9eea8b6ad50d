"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

EDGES = "src long, dst long"


class Forest:
    """Union-find over hashable nodes; the root of a set is its smallest node."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, node):
        path = []
        while (parent := self.up.setdefault(node, node)) != node:
            path.append(node)
            node = parent
        for p in path:
            self.up[p] = node
        return node

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> Iterator[tuple]:
        for node in list(self.up):
            if (root := self.root(node)) != node:
                yield node, root


def spanning_pairs(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a forest that joins what the boolean matrix joins; rows and columns are two sides."""
    edges, rows_left, cols_left = [], near.any(axis=1), near.any(axis=0)
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start], todo = False, [start]
        while todo:
            row = todo.pop()
            new_cols = np.flatnonzero(near[row] & cols_left)
            cols_left[new_cols] = False
            edges += [(row, c) for c in new_cols]
            for c in new_cols:
                new_rows = np.flatnonzero(near[:, c] & rows_left)
                rows_left[new_rows] = False
                edges += [(r, c) for r in new_rows]
                todo.extend(new_rows)
    return edges


def _local_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch: never more edges than the batch had."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        pairs = list(forest.stars())
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], ["src", "dst"])


def _with_min_neighbour(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    return edges.join(low, "src")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches, itself included.

    ``edges`` has two long columns, ``src`` and ``dst``; direction, repeats, loops and NULLs don't matter. Each
    round ends in a reliable checkpoint. Joins on a node with very many neighbours are left to AQE's skew
    splitting; the minimum before them combines map-side. An empty table gives an empty table.
    """
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = durable(edges.mapInArrow(_local_stars, EDGES).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = (_with_min_neighbour(both).where("dst > src")
                 .select(F.col("dst").alias("src"), F.least("src", "low").alias("dst")).distinct())
        small = _with_min_neighbour(large)
        hooked = small.select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        edges = durable(small.select("src", F.col("low").alias("dst")).unionByName(hooked).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
