import hashlib
import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from smelter.llm import alignment
from smelter.llm.queries import PIECES_FILE, QUERIES, TABLE_FILE

A_PATH, B_PATH = public_tokenizers.path(TABLE_FILE), public_tokenizers.path(PIECES_FILE)


@pytest.fixture(scope="module")
def plain():
    """A text's tokens as [(id, bytes)] of both sides, encoded whole by the libraries."""
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    with open(A_PATH, encoding="utf-8") as file:
        entry = {i: e for e, i in json.load(file)["model"]["vocab"].items()}
    byte_of = alignment.byte_characters()

    def tokens(text):
        left = [(i, bytes(byte_of[c] for c in entry[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                 for i in b.encode(text)]
        same = b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode()
        return (left, right) if text and same else ([], [])
    return tokens


def ends(tokens):
    at, out = 0, []
    for _, raw in tokens:
        at += len(raw)
        out.append(at)
    return out


def plain_rows(tokens, docs):
    """Rows as the query returns them, by brute force over all token pairs of each group."""
    per_doc, counts = [], Counter()
    for i, text in docs:
        left, right = tokens(text or "")
        ends_a, ends_b = ends(left), ends(right)
        both = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for high in both:
            groups.append(([t for (t, _), e in zip(left, ends_a) if low < e <= high], [t for (t, _), e in zip(right, ends_b) if low < e <= high]))
            low = high
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        per_doc.append((i, left, right, groups, links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    for i, left, right, groups, links in per_doc:
        listed = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (i, len(left), len(right), len(groups), len(links), sum(counts[l] == most[l[0]] for l in links), sum(counts[l] for l in links),
               hashlib.sha256(listed.encode()).hexdigest() if left else "")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "a", "  a  b ", "a\n b\n\n  c\t", "▁ a", "<|endoftext|> x <s>", "東京タワー naïve 🙂👩‍👧", "\x00\x1c\u0085 ​ z﻿",
       "x" * 400, "don't we'll I'm", "12345 6.7", "end ", "word " * 500, "a b", "ⅷ ㎏ ｶ"]


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_against_brute_force(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert collected(QUERIES["op11_token_alignment"](spark, sf_dir)) == sorted(plain_rows(plain, docs), key=repr)


@pytest.mark.parametrize("limit,step", [(10 ** 6, 1 << 20), (0, 64)])
def test_odd_texts_by_both_joins_and_in_small_steps(spark, make_docs, plain, monkeypatch, limit, step):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("ab cé\n1.東 ") for _ in range(rng.randrange(80))) for _ in range(60)] + ["copy of it"] * 30
    docs = [*enumerate(texts), (None, "no id"), (3, "a")]
    frame = make_docs(docs).repartition(3).withColumns({"pairs": F.lit("x"), "row": F.lit(1), "groups": F.lit("y")})
    monkeypatch.setattr(alignment, "STEP_BYTES", step)
    monkeypatch.setattr(alignment, "STEP_LINKS", step)
    aligned = alignment.align(frame, A_PATH, B_PATH)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    got = alignment.score_links(aligned.withColumn("groups_sha256", digest), alignment.piece_count(B_PATH), broadcast_pairs=limit)
    assert collected(got) == sorted(plain_rows(plain, docs), key=repr)
    assert alignment.score_links(alignment.align(frame.limit(0), A_PATH, B_PATH), 32000).count() == 0


def test_slices_and_blocks_of_links(plain, monkeypatch):
    sides = alignment.Sides(alignment.read_vocabularies(A_PATH, B_PATH))
    text = "some words and some more words, 東京タワー " * 40 + "x" * 300
    whole = alignment._aligned_texts(sides, [text])[0]
    monkeypatch.setattr(alignment, "STEP_BYTES", 40)
    monkeypatch.setattr(alignment, "STEP_LINKS", 3)
    parts = alignment._aligned_texts(sides, [text])[0]
    assert whole[:6] == parts[:6] and np.array_equal(whole[6], parts[6]) and np.array_equal(whole[7], parts[7])
    groups = [g.split("|") for g in whole[5].split(";")]
    assert sum(len(a.split(",")) * len(b.split(",")) for a, b in groups) == whole[4] == whole[7].sum()


def test_overlaps_of_both_directions():
    rng = random.Random(6)
    for _ in range(50):
        cut_a, cut_b = (sorted({0, 40, *rng.sample(range(1, 40), rng.randrange(1, 15))}) for _ in "ab")
        left, right = (pd.DataFrame({"doc": 0, "at": c[:-1], "end": c[1:]}) for c in (cut_a, cut_b))
        want = [(i, j) for i in range(len(left)) for j in range(len(right))
                if cut_a[i] < cut_b[j + 1] and cut_b[j] < cut_a[i + 1]]
        assert list(map(tuple, alignment.overlaps(left, right).tolist())) == want


def test_a_long_run_has_bounded_memory(make_docs):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40000))
    row = alignment.align(make_docs([(1, text), (2, "word " * 60000)]), A_PATH, B_PATH).select("doc_id", "n_a", "n_links", F.size("pairs").alias("n")).collect()
    assert {r["doc_id"] for r in row} == {1, 2} and all(r["n_links"] >= r["n"] > 0 for r in row)
