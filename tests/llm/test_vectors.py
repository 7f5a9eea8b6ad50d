import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from smelter.llm import embeddings, topk
from smelter.llm.embeddings import Quantised, linked_pairs
from smelter.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def same_rows(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=repr)
    return sorted((tuple(r) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op4_exact_top_k"])
def test_query_against_sql(spark, con, sf_dir, name):
    assert same_rows(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def near_rows(n=300, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    return [(base[i % 12] * rng.uniform(0.1, 9) + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.24, 1.0])).tolist()
            for i in range(n)]


def test_bounds_never_lose_or_add_a_link():
    x = np.array(near_rows())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantised(x)
    for threshold in (0.95, 0.5, 0.999, 0.005):
        near = linked_pairs(q, slice(0, None), q, slice(0, None), threshold)
        exact = unit @ unit.T
        clear = np.abs(exact - threshold) > 1e-9
        assert (near == (exact >= threshold))[clear].all()


def test_bands_give_what_one_band_gives(spark):
    rows = [(i, v, 0) for i, v in enumerate(near_rows())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    one = {tuple(r) for r in embeddings.near_duplicates(df).collect()}
    many = {tuple(r) for r in embeddings.near_duplicates(df, band=40).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    counts = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    assert one == many and {i: n for i, n, _, _ in one} == dict(enumerate(counts.tolist()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), math.inf
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, [1.0, 0.0], 3), (3, [1.0, 0.0], 3), (4, None, 1), (5, [], 1),
            (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.0], 1), (None, [0.0, -1.0], 1), (11, [0.0, 0.0], 1), (12, [-0.0, 5.0], 1), (13, [0.0, 5.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"cid": F.lit("x"), "vector": F.lit("y"), "links": F.lit("z")})
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (4, 0, 4, True), (5, 0, 5, True),
            (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True),
            (12, 1, 12, True), (13, 1, 12, False), (None, 4, 1, False), (None, 0, None, False)]
    assert got == sorted(want, key=repr)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def plain_top(rows, k=5):
    whole = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows}
    out = []
    for qi, q in whole:
        if qi % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != qi and len(v) == len(q))
            out += [(qi, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_blocks_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.5, 2.0]) for _ in range(3)]) for i in range(260)]
    rows += [(i, rows[0][1]) for i in range(300, 360)] + [(361, rows[5][1]), (361, rows[5][1])]
    rows += [(-50, [0.5, 0.5, 0.5]), (400, [1.0]), (401, [2.0])]
    odd = [(450, None), (500, []), (550, [float("nan")] * 3), (600, [None, 1.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<double>, label int")
    query = F.col("vec_id") % 50 == 0
    for blocks in ({}, {"query_block": 3, "candidate_block": 50, "pivots": 3}):
        got = sorted(tuple(r) for r in topk.top_k(df, query, **blocks).collect())
        assert got == plain_top(rows)
    assert topk.top_k(df.limit(0), query).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 0), (51, [3e30], 0)], "vec_id long, embedding array<double>, label int")
    assert [r["vec_id"] for r in topk.top_k(alone, query).collect()] == [51]


def test_whole_numbers_beyond_doubles_are_exact():
    x = np.array([[2.0 ** 40 + 1, 1.0], [2.0 ** 40, 3.0]])
    q = np.array([2.0 ** 20 + 1, 1.0])
    assert topk._scores(x, q).tolist() == [(2 ** 40 + 1) * (2 ** 20 + 1) + 1, 2 ** 40 * (2 ** 20 + 1) + 3]
