import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from smelter.llm import sharding
from smelter.llm.queries import QUERIES


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_table(names, slots):
    orders = [[(number(f"{n}:start") + j * (number(f"{n}:stride") % (slots - 1) + 1)) % slots for j in range(slots)]
              for n in names]
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(s for s in orders[turn % len(names)] if s not in owner)] = turn % len(names)
        turn += 1
    return [owner[s] for s in range(slots)]


def test_query_against_brute_force(spark, sf_dir):
    df = QUERIES["op10_shard_placement"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())
    owner = sharding.fill_table(sharding.shard_names(64))
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted((r["doc_id"], r["slot"], r["shard"]) for r in df.collect()) == sorted(
        (i, number(str(i)) % 8191, owner[number(str(i)) % 8191]) for i in ids)


@pytest.mark.parametrize("n, slots", [(1, 2), (5, 101), (7, 7), (10, 251)])
def test_table_is_filled_in_turns(n, slots):
    names = sharding.shard_names(n)
    owner = sharding.fill_table(names, slots)
    assert owner == plain_table(names, slots)
    counts = Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == n


def test_a_lost_shard_moves_little():
    names = sharding.shard_names(20)
    before, after = sharding.fill_table(names, 8191), sharding.fill_table(names[:-1], 8191)
    moved = sum(1 for b, a in zip(before, after) if b != a and b != 19)
    assert moved < 8191 * 0.1


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(names, slots)


def test_odd_rows_and_writing(make_docs, tmp_path):
    docs = make_docs([(1, "a"), (1, "a"), (None, "b"), (None, None)]).withColumns({"slot": F.lit("x"), "shard": F.lit("y")})
    rows = sharding.place(docs, "doc_id", shards=3, slots=101).collect()
    assert len(rows) == 4 and len({(r["slot"], r["shard"]) for r in rows if r["doc_id"] == 1}) == 1
    assert {r["slot"] for r in rows if r["doc_id"] is None} == {number("") % 101}
    assert sharding.place(docs.limit(0), "doc_id").count() == 0
    sharding.write_shards(docs.drop("slot", "shard"), "doc_id", str(tmp_path / "out"), shards=3, slots=101)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == 4
