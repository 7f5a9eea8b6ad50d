"""Alignment of two tokenizers' tokens over the same bytes, and how firmly each link stands in the whole corpus.

A batch's tokens are two tables, one row a token with its document and byte range. ``merge_asof``, keyed by document,
finds for every token's start the other side's token that covers it; both directions together are all overlaps. Where two
overlapping tokens end at the same byte, a group ends. A link is a pair of token occurrences in one group; it is never
written out: a document keeps its different id pairs and how often each is linked.

Both tokenizers are encoded word by word, each different word of a worker's recent texts once: a word starts with a space behind
something that is no white space, where neither tokenizer joins what stands on both sides.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import scratch_path
from .common import Kept

SPACE = "▁"
#: A worker keeps up to twice so many words' ids, none longer than this.
KEPT_WORDS, KEPT_WORD_CHARS = 1 << 17, 48
#: Texts' bytes a step (and a quarter as many ids) and links that are laid out at a time; long documents take several steps.
STEP_BYTES, STEP_LINKS = 1 << 20, 1 << 21
#: Corpus-wide counts of up to so many id pairs are broadcast; beyond, the join shuffles.
BROADCAST_PAIRS = 1_000_000
#: White space, and characters that some Unicode versions count as such.
_BLANK = r"[\s\x1c-\x1f\u0085᠎​-‍⁠﻿]"
_WORDS = re.compile(rf" ++[^ ]*+(?:(?<={_BLANK}) ++[^ ]*+)*+")
_VISIBLE = re.compile(" [!-~]+")
_DIFFERENT = np.zeros(2, np.int32).tobytes()
_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups string, "
            "pairs array<long>, times array<long>")


@dataclass(frozen=True)
class Vocabularies:
    """The two tokenizers' files as they are: broadcast, of the vocabularies' sizes."""

    table: str
    model: bytes
    digest: str


def read_vocabularies(table_path: str, model_path: str) -> Vocabularies:
    with open(table_path, encoding="utf-8") as file:
        table = file.read()
    with open(model_path, "rb") as file:
        model = file.read()
    return Vocabularies(table, model, hashlib.sha256(table.encode() + model).hexdigest())


def piece_count(model_path: str) -> int:
    """The size of B's vocabulary."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model_path).vocab_size()


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 ones for themselves, the others
    for the characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Sides:
    """Both tokenizers in one Python process: words to ids, ids to bytes."""

    def __init__(self, files: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_str(files.table)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.model)
        byte_of = byte_characters()
        entries = {int(i): entry for entry, i in json.loads(files.table)["model"]["vocab"].items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(byte_of[c] for c in entries[i]) if i in entries else b"" for i in range(size)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.blank = self.b.piece_to_id(SPACE)
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: What an id looks like in the text of groups, by what follows it: another of its side, the other side, the next group.
        self.a_text, self.b_text = (np.array([b"%d%s" % (i, mark) for mark in marks for i in range(n)], object)
                                    for n, marks in ((size, (b",", b"|")), (len(self.b_bytes), (b",", b";"))))
        self.fast = self._fast_encoder(json.loads(files.table)["model"])
        self.kept = Kept(KEPT_WORDS)

    def _fast_encoder(self, model: dict):
        """An encoder of words of visible ASCII by the same vocabulary, where its ids are the order of its merges: a quicker
        library gives the same ids there, as the split into words does not depend on Unicode tables."""
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != sorted(made) or len(set(made)) < len(made):
            return None
        import public_tokenizers
        import tiktoken
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if raw}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, words: list[str]) -> list[bytes]:
        """Of words that begin with a space: how many ids A and B have, then both sides' ids, as 32-bit integers. Where a
        side's bytes are not the word's, both numbers are 0."""
        if not words:
            return []
        plain = [bool(_VISIBLE.fullmatch(w)) and self.fast is not None for w in words]
        others = iter(self.a.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        out = []
        for word, is_plain, y in zip(words, plain, self.b.encode([w[1:] for w in words], num_threads=1)):
            x, y = self.fast(word) if is_plain else next(others).ids, y if word != " " else [self.blank]
            raw = word.encode()
            if b"".join([self.a_bytes[i] for i in x]) == raw and b"".join([self.b_bytes[i] for i in y]) == raw:
                out.append(array("i", [len(x), len(y), *x, *y]).tobytes())
            else:
                out.append(_DIFFERENT)
        return out

    def ids_of(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words of all texts as ``encode`` gives them, and how many words each text has."""
        kept, missing, found, counts = self.kept, {}, [], []
        for text in texts:
            words = _WORDS.findall(" " + text) if text and SPACE not in text else []
            young = kept.young
            for word in words:
                ids = young.get(word)
                if ids is None and (ids := kept.from_old(word)) is None:
                    ids = word
                    missing.setdefault(word)
                found.append(ids)
            counts.append(len(words))
        for word, ids in zip(missing, self.encode(list(missing))):
            missing[word] = kept.put(word, ids) if len(word) <= KEPT_WORD_CHARS else ids
        return [missing[x] if type(x) is str else x for x in found], np.array(counts)


_SIDES: dict[str, Sides] = {}


def sides_of(files: Vocabularies) -> Sides:
    if files.digest not in _SIDES:
        _SIDES.clear()
        _SIDES[files.digest] = Sides(files)
    return _SIDES[files.digest]


def overlaps(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Places (token of A, token of B) of all overlapping tokens, in order. Both tables have doc, at and end, sorted by at."""
    a = left.assign(a=np.arange(len(left)))[["doc", "at", "a"]]
    b = right.assign(b=np.arange(len(right)))[["doc", "at", "b"]]
    both = [pd.merge_asof(x, y, on="at", by="doc") for x, y in ((a, b), (b, a))]
    keys = np.concatenate([m["a"].to_numpy() * len(right) + m["b"].to_numpy() for m in both])
    keys.sort(kind="stable")  # two runs that are in order already
    keys = keys[np.append(True, keys[1:] != keys[:-1])[:len(keys)]]
    return np.stack([keys // max(len(right), 1), keys % max(len(right), 1)], axis=1)


def _summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of each one's times, 1 where none are given."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(firsts, len(keys))) if times is None else np.add.reduceat(times, firsts) if len(keys) else times
    return keys[firsts], sums.astype(np.int64)


def _linked(doc: np.ndarray, a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc << 32 | a * width + b, times) of the links of all groups: group g has a[a_starts[g]:a_starts[g + 1]] and b likewise.

    Links are laid out in steps of bounded size; a group beyond that is reduced to its different ids first, block by block.
    """
    na, nb = np.diff(a_starts), np.diff(b_starts)
    product = na * nb
    large = np.flatnonzero(product > STEP_LINKS)
    keys, times = [], []
    for g in large:
        ua, ca = np.unique(a[a_starts[g]:a_starts[g + 1]], return_counts=True)
        ub, cb = np.unique(b[b_starts[g]:b_starts[g + 1]], return_counts=True)
        step = max(1, STEP_LINKS // len(ub))
        for s in range(0, len(ua), step):
            keys.append(((doc[g] << 32) + ua[s:s + step, None] * width + ub[None, :]).ravel())
            times.append((ca[s:s + step, None] * cb[None, :]).ravel())
    product[large] = 0
    part = np.cumsum(product) // STEP_LINKS
    for p in np.unique(part):
        groups = np.flatnonzero((part == p) & (product > 0))
        if not len(groups):
            continue
        n = product[groups]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = np.repeat(groups, n)
        k, t = _summed((doc[g] << 32) + a[a_starts[g] + within // nb[g]] * width + b[b_starts[g] + within % nb[g]])
        keys.append(k)
        times.append(t)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(np.concatenate(keys), np.concatenate(times))


def align_ids(sides: Sides, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[tuple]:
    """(groups, overlaps, text of groups, pairs, times) of slices that lie one after the other in ``a`` and ``b``; slice i has
    n_a[i] and n_b[i] ids of the same bytes."""
    slices = range(len(n_a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    doc_a, doc_b = np.repeat(np.arange(len(slices)), n_a), np.repeat(np.arange(len(slices)), n_b)
    end_a, end_b = np.cumsum(sides.a_length[a]), np.cumsum(sides.b_length[b])
    left = pd.DataFrame({"doc": doc_a, "at": end_a - sides.a_length[a], "end": end_a})
    right = pd.DataFrame({"doc": doc_b, "at": end_b - sides.b_length[b], "end": end_b})
    both = overlaps(left, right)
    closing = both[end_a[both[:, 0]] == end_b[both[:, 1]]]  # one row a group: its last tokens
    doc = doc_a[closing[:, 0]]
    a_starts, b_starts = np.append(0, closing[:, 0] + 1), np.append(0, closing[:, 1] + 1)
    keys, times = _linked(doc, a, a_starts, b, b_starts, len(sides.b_bytes))
    # The text: tokens of A before those of B, group after group.
    group_a = np.repeat(np.arange(len(closing)), np.diff(a_starts))
    group_b = np.repeat(np.arange(len(closing)), np.diff(b_starts))
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[closing[:, 0]], last_b[closing[:, 1]] = 1, 1
    texts = np.empty(len(a) + len(b), object)
    texts[np.arange(len(a)) + b_starts[group_a]] = sides.a_text[a + last_a * len(sides.a_bytes)]
    texts[np.arange(len(b)) + a_starts[group_b + 1]] = sides.b_text[b + last_b * len(sides.b_bytes)]
    bounds = np.append(0, np.cumsum(n_a + n_b))
    key_bounds = np.searchsorted(keys, np.arange(len(slices) + 1) << 32)
    n_groups, n_overlaps = np.bincount(doc, minlength=len(slices)), np.bincount(doc_a[both[:, 0]], minlength=len(slices))
    texts = texts.tolist()
    return [(int(n_groups[i]), int(n_overlaps[i]), b"".join(texts[bounds[i]:bounds[i + 1]])[:-1],
             keys[key_bounds[i]:key_bounds[i + 1]] & 0xFFFFFFFF, times[key_bounds[i]:key_bounds[i + 1]]) for i in range(len(slices))]


def _aligned_texts(sides: Sides, texts: list[str]) -> list[tuple]:
    """Rows (n_a, n_b, n_groups, n_overlaps, n_links, groups, pairs, times), one for each text.

    Tokens are aligned in steps of bounded size that end with a word: groups are whole, and what steps find adds up.
    """
    words, counts = sides.ids_of(texts)
    found: list[list] = [[] for _ in texts]
    flat = np.frombuffer(b"".join(words), np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) // 4
    heads = np.cumsum(lengths) - lengths
    n_a, n_b, owner = flat[heads].astype(np.int64), flat[heads + 1].astype(np.int64), np.repeat(np.arange(len(texts)), counts)
    whole = np.bincount(owner, weights=n_a == 0, minlength=len(texts)) == 0  # both sides' bytes are those of the text
    used = whole[owner]
    owner_used, steps = owner[used], np.cumsum(lengths[used]) // (STEP_BYTES // 4)
    side = np.repeat(np.tile([2, 0, 1], len(words)), np.stack([np.full(len(words), 2), n_a, n_b], axis=1).ravel())
    side[np.repeat(~used, lengths)] = 2
    ids_a, ids_b = flat[side == 0], flat[side == 1]
    # A slice is one text's words in one step.
    firsts = np.flatnonzero(np.append(True, (owner_used[1:] != owner_used[:-1]) | (steps[1:] != steps[:-1]))[:len(steps)])
    if len(firsts):
        slice_a, slice_b = np.add.reduceat(n_a[used], firsts), np.add.reduceat(n_b[used], firsts)
        ends_a, ends_b = np.append(0, np.cumsum(slice_a)), np.append(0, np.cumsum(slice_b))
        bounds = np.flatnonzero(np.append(np.append(True, steps[firsts][1:] != steps[firsts][:-1]), True))
        for low, high in zip(bounds[:-1], bounds[1:]):
            results = align_ids(sides, ids_a[ends_a[low]:ends_a[high]], ids_b[ends_b[low]:ends_b[high]], slice_a[low:high], slice_b[low:high])
            for k, result in enumerate(results, low):
                found[owner_used[firsts[k]]].append((int(slice_a[k]), int(slice_b[k]), *result))
    rows = []
    for parts in found:
        if not parts:
            rows.append((0, 0, 0, 0, 0, "", [], []))
            continue
        pairs, times = parts[0][5:] if len(parts) == 1 else _summed(
            np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts]))
        rows.append((sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts), sum(p[3] for p in parts),
                     int(times.sum()), b";".join([p[4] for p in parts]).decode(), pairs, times))
    return rows


def _align_batches(files, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = sides_of(files.value)
    for batch in batches:
        start = held = 0
        sizes = batch.column(1)
        for at in range(batch.num_rows):
            held += len(sizes[at].as_py())
            if held >= 4 * STEP_BYTES or at == batch.num_rows - 1:
                part = batch.slice(start, at + 1 - start)
                rows = _aligned_texts(sides, part.column(1).to_pylist())
                columns = list(zip(*rows))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, column)]), pa.int32()),
                                                  pa.array(np.concatenate(column).astype(np.int64))) for column in columns[6:]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string()), *lists],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups", "pairs", "times"])
                start, held = at + 1, 0


def align(docs: DataFrame, table_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups, pairs, times), one row per row of ``docs``.

    A is the byte-level tokenizer of a JSON file over a space and the text, B the SentencePiece model over the text.
    ``groups`` lists ids as ``a1,a2|b1;a3|b2,b3``; ``pairs`` has the different linked id pairs, as a times the size of B's
    vocabulary plus b, ``times`` how often each is linked. Texts that are NULL or empty, and texts whose tokens' bytes on
    either side are not those of a space and the text, have zeros and empty values. Texts are read whole; rows that repeat
    stay; an empty table gives an empty table; other columns are not read.
    """
    files = docs.sparkSession.sparkContext.broadcast(read_vocabularies(table_path, model_path))
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"),
                       F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _align_batches(files, batches), _ALIGNED)


def score_links(aligned: DataFrame, n_b_ids: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` without pairs and times, but with ``n_best`` and ``count_sum``.

    A pair's count is the number of rows that hold it linked. ``count_sum`` adds the counts of a row's links, ``n_best``
    counts its links whose count is the highest of their A id, ties included. ``n_b_ids`` is the size of B's vocabulary.
    The rows are stored once, without what other columns need; counts of many pairs are joined by a shuffle. A row without
    links has zeros.
    """
    spark = aligned.sparkSession
    path = scratch_path(spark, "aligned")
    aligned.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    counted = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts_path = scratch_path(spark, "pair-counts")
    counted.write.parquet(counts_path)
    counts = spark.read.parquet(counts_path).withColumn("a", F.floor(F.col("pair") / n_b_ids))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row an id of A
    graded = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if counts.count() <= broadcast_pairs:
        graded = F.broadcast(graded)
    links = stored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = links.join(graded, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    return stored.select("row", *rest).join(sums, "row", "left").select(
        *rest, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
