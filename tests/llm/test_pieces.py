import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from smelter.llm import pieces
from smelter.llm.queries import PIECES_FILE, QUERIES

PATH = public_tokenizers.path(PIECES_FILE)
ALPHABETS = ["abcdefgh", "etaoin shrdlu", "  \n a.", "0123456789 .,", "▁ a", "ñéü东京 カ", "🙂👩‍👧x", "\x00\x7f ﻿́e", "<>/s_0xA ", "s.,;:!?²t "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


def test_query_against_the_library(spark, sf_dir, library):
    rows = QUERIES["op13_sentence_pieces"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = set()
    for i, text in texts.items():
        ids = library.encode(text, add_eos=True)
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected
    assert len(rows) == len(texts)


def test_random_texts_and_ids(library, model):
    rng, coder = random.Random(3), pieces.PieceCoder(model)
    texts = ["".join(rng.choice(rng.choice(ALPHABETS) if k % 3 else ALPHABETS[k % 10]) for _ in range(rng.randrange(60)))
             for k in range(4000)]
    texts += [head + " " * n + tail for n in (0, 1, 2, 15, 16, 17, 18, 33, 40) for tail in ("", "a", "\n", "the") for head in ("", "x")]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert coder.encode(text).tolist() == ids, text
        assert coder.decode(ids) == library.decode(ids), text
    for k in range(2000):
        ids = [rng.randrange(32000 if k % 2 else 300) for _ in range(rng.randrange(8))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_small_tables_of_kept_answers_change_nothing(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CUTS", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 2)
    coder = pieces.PieceCoder(model)
    for text in ["one two, three two. one", "aaaa bbbb cccc dddd eeee ffff aaaa", "hello, hello; hello"] * 2:
        assert coder.encode(text).tolist() == library.encode(text, add_eos=True)
    assert len(coder.kept.young) <= 3 and len(coder.kept.old) <= 3


def test_long_runs_take_linear_time(library, model):
    rng, coder = random.Random(4), pieces.PieceCoder(model)
    for text in ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60000)), "a" * 60000, "東京" * 30000, " " * 60000]:
        assert coder.encode(text).tolist() == library.encode(text, add_eos=True)


def test_odd_rows(spark, make_docs, library, model):
    texts = {1: None, 2: "", 3: " ", 4: "a\nb", 5: "x " * 50000, 6: "▁ a", 7: "don't </s> <0x41>"}
    docs = make_docs([*texts.items(), (7, texts[7]), (None, "no id")]).withColumns({"ids": F.lit("x"), "decoded": F.lit(1), "piece": F.lit("p")})
    rows = pieces.encode_documents(docs, PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text, add_eos=True) and r["decoded"] == library.decode(r["ids"])
    kept = pieces.encode_column(docs, model, end=False)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece", "ids", "decoded"]
    assert {r["piece"] for r in kept.collect()} == {"p"}
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_batches_of_few_ids(spark, make_docs, library, monkeypatch):
    docs = make_docs([(i, f"text number {i} " * (i % 4)) for i in range(200)])
    monkeypatch.setattr(pieces, "BATCH_IDS", 10)
    got = {r["doc_id"]: r["ids"] for r in pieces.encode_documents(docs, PATH).collect()}
    assert got == {i: library.encode(f"text number {i} " * (i % 4), add_eos=True) for i in range(200)}
