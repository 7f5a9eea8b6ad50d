"""Embedding near-duplicates: int8 tile products with per-vector error bounds, exact cosines only where in doubt.

Equal vectors are one class, so a group of copies costs one vector. Classes are hashed into bands of bounded size;
each pair of bands is one task. A unit vector x is stored as s * q + e with q in int8 and |e| known, hence

    |x.y - s_x s_y (q_x . q_y)| <= |s_x q_x| |e_y| + |e_x| |y|

Pairs whose bound stays below the threshold are done, pairs whose bound lies above it are links, and only the rest is
recomputed in double precision. A task returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .graph import Forest, components, spanning_pairs
from .vectors import finite, matrix

THRESHOLD = 0.95
BAND = 8192
TILE = 1024
_ROUNDING = 1e-9
_PAIR_CHUNK = 1 << 14
_LINKS = "cid long, links long, root long"


class Quantised:
    """Unit vectors, their int8 forms, and the error bound of each."""

    def __init__(self, vectors: np.ndarray) -> None:
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.step = np.abs(self.unit).max(axis=1) / 127.0
        self.codes = np.rint(self.unit / self.step[:, None]).astype(np.int8)
        rounded = self.codes * self.step[:, None]
        self.error = np.sqrt(((self.unit - rounded) ** 2).sum(axis=1)) + _ROUNDING
        self.length = np.sqrt((rounded ** 2).sum(axis=1)) + _ROUNDING

    def codes_for_product(self, rows: slice) -> np.ndarray:
        """int8 codes in a float type that holds the integer products exactly and uses the BLAS."""
        exact_in_single = self.codes.shape[1] * 127 * 127 < 1 << 24
        return self.codes[rows].astype(np.float32 if exact_in_single else np.float64)


def linked_pairs(a: Quantised, rows: slice, b: Quantised, cols: slice, threshold: float) -> np.ndarray:
    """Boolean matrix of the tile: which pairs have a cosine of at least ``threshold``."""
    product = a.codes_for_product(rows) @ b.codes_for_product(cols).T
    step_a, step_b = a.step[rows], b.step[cols]
    # The cheap screen takes the largest bound of the tile; what passes it gets its own bound.
    widest = a.length[rows].max() * b.error[cols].max() + a.error[rows].max() + _ROUNDING
    least = (threshold - widest) / step_a[:, None]
    linked = np.zeros(product.shape, dtype=bool)
    near_i, near_j = np.nonzero(product * step_b[None, :].astype(product.dtype) >= least.astype(product.dtype) * (1 - 1e-6)
                                if threshold > widest else np.ones(product.shape, dtype=bool))
    for at in range(0, len(near_i), _PAIR_CHUNK):
        i, j = near_i[at:at + _PAIR_CHUNK], near_j[at:at + _PAIR_CHUNK]
        near = product[i, j].astype(np.float64) * step_a[i] * step_b[j]
        bound = a.length[rows][i] * b.error[cols][j] + a.error[rows][i] + _ROUNDING
        sure = near - bound >= threshold
        linked[i[sure], j[sure]] = True
        doubt = ~sure & (near + bound >= threshold)
        i, j = i[doubt], j[doubt]
        if len(i):
            exact = np.einsum("kd,kd->k", a.unit[rows][i], b.unit[cols][j])
            linked[i, j] = exact >= threshold
    return linked


def _band_pair(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        band = rows.column("band").to_numpy()
        cid, copies = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
        left, right = np.flatnonzero(band == low), np.flatnonzero(band == high)
        links, forest = np.zeros(len(band), dtype=np.int64), Forest()
        if len(left) and len(right):
            vectors = matrix(rows.column("vector"))
            a = Quantised(vectors[left])
            b = a if low == high else Quantised(vectors[right])
            for r0 in range(0, len(left), TILE):
                for c0 in range(r0 if low == high else 0, len(right), TILE):
                    near = linked_pairs(a, slice(r0, r0 + TILE), b, slice(c0, c0 + TILE), threshold)
                    if low == high and r0 == c0:
                        near = near | near.T
                        np.fill_diagonal(near, False)
                    if not near.any():
                        continue
                    at, to = left[r0:r0 + TILE], right[c0:c0 + TILE]
                    links[at] += near @ copies[to]
                    if low != high or r0 != c0:
                        links[to] += near.T @ copies[at]
                    for i, j in spanning_pairs(near):
                        forest.join(int(cid[at[i]]), int(cid[to[j]]))
        found = np.flatnonzero(links)
        return pa.table({"cid": cid[found], "links": links[found],
                         "root": np.array([forest.root(int(c)) for c in cid[found]], dtype=np.int64)})
    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, band: int = BAND) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Two rows link if their cosine in double precision is at least ``threshold``, whatever else they hold. Vectors
    that are NULL, empty, zero, or hold NULL or non-finite components link with nothing, and so do vectors of
    different lengths. Equal vectors link. A row without vec_id counts as a vector; its component is named after the
    rows that have ids, its ``kept`` is false. Rows that repeat an id stay separate rows. An empty table gives an
    empty table. ``threshold`` must be positive.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    usable = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    good = rows.where(usable)
    # The stored ids are the same in every later read, also when a task is run again.
    classes = durable(good.groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
                      .withColumn("cid", F.monotonically_increasing_id()))
    bands = max(1, -(-classes.count() // band))
    dealt = (classes.select("cid", "copies", "vector", F.size("vector").alias("dim"),
                            F.pmod(F.xxhash64("vector"), F.lit(bands)).cast("int").alias("band"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))))
    links = durable(dealt.groupBy("dim", F.least("band", "other").alias("low"), F.greatest("band", "other").alias("high"))
                    .applyInArrow(_band_pair(threshold), _LINKS))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    named = reached.join(classes.select("cid", "least_id"), F.col("node") == F.col("cid")).select("cid", "component", "least_id")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = named.join(least, "component").select("cid", "component_id")
    labelled = (classes.join(counts, "cid", "left").join(found, "cid", "left")
                .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component_id", "least_id").alias("component_id")))
    linked = good.join(labelled, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
