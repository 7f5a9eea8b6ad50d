import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from smelter.llm import mixing
from smelter.llm.queries import QUERIES


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in names if s not in stopped) or 1
        target = {s: 3.0 * sizes[s] if s in stopped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def check_mix(rows, docs):
    size_of = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, t, s in docs:
        sizes[s] += size_of[d]
        largest[s] = max(largest[s], size_of[d])
    target = plain_targets(sizes)
    source = {d: s for d, _, s in docs}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return taken


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    first = QUERIES["op2_source_mix"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", first._jdf.queryExecution().executedPlan().toString())
    rows = first.collect()
    check_mix(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op2_source_mix"](spark, sf_dir).collect()))


def test_odd_sources(make_docs):
    rows = [(i, f"w{i} " * (1 + i % 9), None, None if i % 7 == 0 else f"s{i % 5}") for i in range(120)]
    rows += [(200, None, None, "s1"), (201, "  ", None, "void"), (202, "tiny", None, "ä"), (203, "big " * 5000, None, "s2")]
    docs = make_docs(rows)
    check_mix(mixing.mix(docs).collect(), [(r[0], r[1], r[3]) for r in rows])
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(make_docs([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in nothing) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_repeated_rows_are_taken_alike_and_documents_follow(make_docs):
    rows = [(i, f"a{i} b c", None, "x" if i % 3 else "y") for i in range(60)] + [(500, "same text", None, "x")] * 4
    docs = make_docs(rows).withColumns({"key": F.lit("k"), "full": F.lit(7), "doc": F.lit("d"), "cut": F.lit(1)})
    taken = {}
    for r in mixing.mix(docs).collect():
        assert taken.setdefault(r["doc_id"], r["taken"]) == r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n * (4 if i == 500 else 1) // (2 if i == 500 else 3) for i, n in taken.items() if n}
    assert {(r["key"], r["full"], r["doc"], r["cut"]) for r in mixed.collect()} == {("k", 7, "d", 1)}
    assert mixing.mixed_documents(make_docs([(1, None)])).count() == 1


def test_a_larger_budget_never_takes_less(make_docs):
    docs = make_docs([(i, f"w{i} x y", None, f"s{i % 3}") for i in range(90)])
    small = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights=(1, 2, 3)).collect()}
    large = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights=(1, 2, 6)).collect()}
    assert all(large[i] >= small[i] for i in small if i % 3 == 2)
