import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from smelter.llm import ranked
from smelter.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] from rows (doc_id, text) and (item_id, text)."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in items:
        scores = []
        terms = set(plain_terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counted) + 1))) for t in terms}
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_sql(spark, con, sf_dir):
    df = QUERIES["op12_ranked_search"](spark, sf_dir)
    result = con.execute(ORACLES["op12_ranked_search"])
    names = [d[0] for d in result.description]
    assert in_order(df.collect()) == in_order(tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall())


def test_terms():
    for text in ["Ab-cD_é ÄÖ 12.5\x00x 東京　タワー\u0085z", "", "...", "A" * 50, "ß ſ K"]:
        assert [t.decode() for t in ranked.terms_of(text)] == plain_terms(text)
    assert ranked.terms_of(None) == []


@pytest.mark.parametrize("blocks,terms", [(10 ** 6, 10 ** 6), (40, 10 ** 6), (60, 5)])
def test_random_rows_against_brute_force(spark, make_docs, monkeypatch, blocks, terms):
    """Hot words, copies of a third of all rows, ties, rows without ids, many blocks, items in several groups."""
    rng = random.Random(9)
    words = [f"w{int(rng.expovariate(0.15))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(150)]
    rows += [(200 + i, "w1 W2 w3 w0 w7") for i in range(60)] + [(None, "w1 w2 w3 w0 w7"), (None, "w5"), (3, "w5 w5"), (400, None), (401, "")]
    items = [(1, "w1 w2, w3"), (2, "W5 w5 zz"), (3, "none of these"), (4, None), (5, ""), (6, " ".join(set(words))), (7, "w0 w7"), (7, "w9")]
    docs = make_docs(rows).repartition(6).withColumns({"item_id": F.lit("x"), "terms": F.lit(1), "block": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = ranked.search(docs, asked, block_postings=blocks, query_terms=terms).collect()
    assert in_order(got) == in_order(plain_search(rows, items))


def test_empty_tables_and_other_item_ids(spark, make_docs):
    asked = spark.createDataFrame([("a", "word one"), ("b", None)], "item_id string, text string")
    assert ranked.search(make_docs([]), asked).count() == 0
    assert ranked.search(make_docs([(1, "word")]), asked.limit(0)).count() == 0
    rows = ranked.search(make_docs([(1, "word of a day"), (2, "other one here"), (3, "x " * 200000 + "one")]), asked, k=2).collect()
    assert [(r["item_id"], r["rank"]) for r in sorted(rows)] == [("a", 1), ("a", 2)]


def test_range_maxima():
    rng = np.random.default_rng(2)
    docs, terms = np.arange(300) % 100, np.arange(300) // 100
    block = ranked.Block(docs, 100, terms, rng.integers(0, 20, 300), 3)
    for _ in range(500):
        t = rng.integers(3)
        low, high = sorted(rng.integers(0, 101, 2) + 100 * t)
        place = block.maxima(np.array([low]), np.array([high]))[0]
        want = low + int(np.argmax(block.factors[low:high])) if high > low else -1
        assert place == want
