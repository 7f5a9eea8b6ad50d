import random
from itertools import combinations

import xxhash

from smelter.llm import simhash
from smelter.llm.graph import components
from smelter.llm.queries import QUERIES


def plain_print(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict) -> dict:
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in prints}


def test_query_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    expected = plain_components(prints)
    rows = QUERIES["op9_simhash_near_dedup"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (i, f"{prints[i]:016x}", expected[i]) for i in texts}
    assert len(rows) == len(texts)


def test_hash_is_sparks_xxhash64(spark):
    row = spark.sql("select xxhash64('the quick fox') as h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"the quick fox", 42)


def test_every_pair_up_to_three_bits_is_joined_also_over_tiles(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for seed in seeds:
        for _ in range(4):
            prints.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))))
    centre = seeds[0]
    prints |= {centre ^ (1 << a) ^ (1 << b) for a, b in combinations(range(30), 2)}
    numbered = dict(enumerate(sorted(prints)))
    expected = plain_components(numbered)
    rows = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in numbered.values()], "fp long")
    for tile in (2048, 16):
        edges = simhash.near_edges(rows, tile=tile)
        if tile == 2048:
            assert edges.count() < 20 * len(prints)
        groups = {}
        for r in components(edges).collect():
            groups.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
        want = {}
        for i, root in expected.items():
            want.setdefault(root, set()).add(numbered[i])
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_odd_rows(make_docs):
    long_text = "one two three " * 40000
    docs = make_docs([(1, None), (2, ""), (3, " \n\t"), (4, "Hello"), (5, "HELLO"), (5, "HELLO"), (6, "hello there"),
                      (7, long_text), (None, long_text), (None, "only here without id")])
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (None, 7), (None, None)}
    assert simhash.fingerprint_of(b"") == 0 and simhash.fingerprint_of("Ä b".encode()) == plain_print("Ä b")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:10]) for r in kept) == [
        (0, "only here "), (1, ""), (4, "Hello"), (6, "hello ther"), (7, "one two th")]


def test_empty_table_and_clashing_columns(make_docs):
    empty = make_docs([])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    from pyspark.sql import functions as F
    docs = make_docs([(1, "a b c d"), (2, "a b c d")]).withColumns(
        {"fp": F.lit("x"), "component_id": F.lit("y"), "node": F.lit("z")})
    kept = simhash.drop_near_duplicates(docs).collect()
    assert [(r["doc_id"], r["fp"], r["component_id"], r["node"]) for r in kept] == [(1, "x", "y", "z")]


def test_one_row_of_each_group_stays_whatever_ids_repeat(make_docs):
    first, other = "red green blue white black grey", "one two three four five six seven"
    docs = make_docs([(2, first, "en"), (2, other, "en"), (2, other, "en"), (3, first, "de"), (4, other, "en"), (5, "a b c", "en"),
                      (5, "a b c", "fr"), (None, "lone row without an id"), (None, "lone row without an id"), (6, None), (7, "")])
    kept = sorted(((r["doc_id"] or 0, r["text"], r["lang"]) for r in simhash.drop_near_duplicates(docs.repartition(5)).collect()), key=repr)
    assert [k[:2] for k in kept] == [(0, "lone row without an id"), (2, other), (2, first), (5, "a b c"), (6, None)]
    again = simhash.drop_near_duplicates(docs.repartition(3)).collect()
    assert sorted(((r["doc_id"] or 0, r["text"], r["lang"]) for r in again), key=repr) == kept


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 3)]
    rows = spark.createDataFrame(chain, "src long, dst long").repartition(7)
    got = {r["node"]: r["component"] for r in components(rows).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(rows.limit(0)).count() == 0
