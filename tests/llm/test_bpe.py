import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from smelter.llm import bpe
from smelter.llm.queries import QUERIES, RANKS_FILE

PATH = public_tokenizers.path(RANKS_FILE)


@pytest.fixture(scope="module")
def exact():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_against_the_library(spark, sf_dir, exact):
    df = QUERIES["op7_byte_bpe"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"transform\(__rare__.*aggregate\(", plan)  # words are folded by higher-order functions
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = set()
    for i, text in texts.items():
        ids = exact.encode_ordinary(text)
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == expected


ODD = ["", " ", "a", "  two  blanks \n\n\t end ", "aaaa aaaaaaaaaaaaaaaa", "don't we'll I'm THEY'RE", "naïve café ЖЁЛТЫЙ 東京タワー",
       "🙂🙂👩‍👩‍👧 ok", "  　x\u0085y​", "x" * 300, "1234567890 ²³ ½ 一二三", "!!!??? ... --- ===", "<|endoftext|>",
       "\x00\x01\x7f﻿", "a\r\nb\r\n\r\n  c", "zażółć gęślą jaźń " * 300, ",".join(map(str, range(400)))]


def test_odd_texts_and_the_round_trip(make_docs, exact):
    docs = make_docs([(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "null id"), (3, ODD[3])]).withColumns(
        {"ids": F.lit("x"), "word": F.lit("y"), "slot": F.lit(1)})
    coded = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(coded) == len(ODD) + 3
    for r in coded:
        text = "null id" if r["doc_id"] is None else "" if r["doc_id"] == 100 else ODD[r["doc_id"]]
        assert r["ids"] == exact.encode_ordinary(text), text
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_do_not_depend_on_the_table_of_frequent_words(make_docs, exact):
    docs = make_docs([(i, t * 2) for i, t in enumerate(ODD)])
    coder = bpe.ByteBpe(docs.sparkSession, PATH, public_tokenizers.PATTERN)
    bare = {r["doc_id"]: r["coded"]["ids"] for r in coder.encode(docs, "text").collect()}
    stored = docs.limit(1).select(F.array(*[F.lit(i) for i in exact.encode_ordinary("give back")]).alias("ids"))
    assert bytes(coder.decode(stored, "ids").first()["decoded"]) == b"give back"
    coder.learn_frequent_words(docs.select(F.col("doc_id").alias("key"), "text"))
    assert bare == {r["doc_id"]: r["coded"]["ids"] for r in coder.encode(docs, "text").collect()}


def test_words_are_cut_alike_by_both_libraries():
    draw = random.Random(5)
    chars = [chr(c) for c in range(128)] + [" ", "\n", "'", "s", "1"] * 8
    texts = ["".join(draw.choices(chars, k=draw.randrange(14))) for _ in range(20_000)] + ODD
    patterns = [public_tokenizers.PATTERN, r"(?i:'s|'t)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+",
                r"[\]\p{L}]+|\[|.", r"\p{Lu}+|\P{L}|.", r"[\p{L}--[a-z]]|."]
    for pattern in patterns:
        cut, plain = bpe.word_cutter(pattern), regex.compile(pattern).findall
        assert all(cut(t) == plain(t) for t in texts), pattern


def test_equal_ranks_merge_from_the_left(spark, tmp_path):
    """Several splits of one token, side by side, in every word of three letters up to nine long."""
    tokens = [bytes([b]) for b in range(256)] + [b"aa", b"aaa", b"ab", b"ba", b"aba", b"bab", b"abab", b"aaaa", b"cab"]
    path = tmp_path / "ties"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    exact = tiktoken.Encoding("ties", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    draw = random.Random(6)
    texts = [" ".join("".join(draw.choices("aabbc", k=draw.randrange(1, 10))) for _ in range(300)) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coder = bpe.ByteBpe(spark, str(path), r"\S+")
    for r in coder.encode(docs, "text").collect():
        assert r["coded"]["ids"] == exact.encode_ordinary(texts[r["doc_id"]])


def test_every_pair_of_a_vocabulary_has_a_place_of_its_own(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"aa", b"aaa", b"aaaa"]
    path = tmp_path / "tiny"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    ranks = bpe.read_ranks(str(path))
    assert sorted(r for r in ranks.ranks if r != -1) == sorted(
        tokens.index(t) for t in tokens[256:] for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens)


def test_steps_of_few_words_and_long_runs(make_docs, exact, monkeypatch):
    rng = random.Random(2)
    texts = [*ODD, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), *["rare" + str(i % 3) + " words " * (i % 5) for i in range(40)]]
    docs = make_docs(list(enumerate(texts))).repartition(2)
    monkeypatch.setattr(bpe, "STEP_WORDS", 7)
    rows = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: exact.encode_ordinary(t) for i, t in enumerate(texts)}


def test_the_most_frequent_words_are_taken(spark):
    counted = spark.createDataFrame([(f"w{i}", 2 + i // 10) for i in range(200)] + [("often", 10 ** 6)], "word string, n long")
    taken = {r["word"] for r in bpe._frequent(counted, 55).collect()}
    assert "often" in taken and {f"w{i}" for i in range(150, 200)} <= taken and len(taken) <= 61
    assert bpe._frequent(counted, 1000).count() == 201


def test_texts_are_cut_in_steps_and_tasks_need_one_worker_at_a_time(make_docs, exact, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(bpe, "STEP_WORDS", 7)
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": ["a few words here"] * 39 + [None]})
    steps = list(bpe._cut(bpe.WordNumbers(["a"], "steps"), public_tokenizers.PATTERN, ["id"], 1, [batch]))
    assert [s.num_rows for s in steps] == [2] * 20 and [i for s in steps for i in s.column(0).to_pylist()] == list(range(40))
    docs = make_docs([(i, t) for i, t in enumerate(ODD)] + [(100, None)])
    coder = bpe.ByteBpe(docs.sparkSession, PATH, public_tokenizers.PATTERN)
    coded = coder.encode(docs.select("doc_id", "text"), "text", keep_text=False, stored=True)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan
    assert {r["doc_id"]: r["coded"]["ids"] for r in coded.collect()} == {
        **{i: exact.encode_ordinary(t) for i, t in enumerate(ODD)}, 100: []}
