"""Byte-level BPE: distinct words are folded in Spark's higher-order functions, documents are put together from them.

A text is cut into words by the tokenizer's pattern. A word's bytes are folded: of all neighbouring pairs the one with the
lowest rank merges, until no pair has a rank. Ranks of pairs lie in a perfect hash table that every task gets as the value
of a subquery, which the planner makes a literal, so a look-up is two array accesses. No word is folded twice without need:
frequent words, a bounded number of them, are folded once and broadcast with their ids; of its other words a document
folds the different ones. Cutting texts and putting ids in their words' places are Arrow steps around the folds: they
look words up and copy ids, and merge nothing. Decoding concatenates the tokens' bytes.

A fold copies its state at each merge: a word of n bytes takes time in proportion to n squared, and memory to n.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..session import durable, scratch_path
from .common import fraction_below, let

#: The table of frequent words: at most so many, of at most so many bytes, from about so many documents.
FREQUENT_WORDS, FREQUENT_BYTES, WORD_SAMPLE = 400_000, 64, 60_000
#: Counts above this are alike when the least count of a frequent word is sought.
_MOST_COUNT = 1 << 12
#: Documents are put together in steps of about so many words.
STEP_WORDS = 1 << 17
_NONE = -1
_TABLES, _CODES, _RARE, _FOLDED = "__rank_tables__", "__codes__", "__rare__", "__folded__"
#: Bits of an id or rank in the state of a fold; the highest such number stands for no rank.
_BITS = 17
_LAST = (1 << _BITS) - 1
#: Bits of a token's first byte in the state of a fold, and where its rank begins: rank, first byte, id.
_PLACE_BITS = 29
_RANK_AT = _BITS + _PLACE_BITS
_PLACE = ((1 << _PLACE_BITS) - 1) << _BITS
_BUCKETS, _STRIDES = 30011, 7919


@dataclass(frozen=True)
class Ranks:
    """A vocabulary as arrays: tokens' bytes, the id of each byte, and the hash table of mergeable pairs."""

    pieces: list[bytes]
    byte_ids: list[int]
    slots: int
    shifts: list[int]
    ranks: list[int]
    keys: list[int]


def read_ranks(path: str) -> Ranks:
    """Read a rank file: a line holds a token's bytes in base64 and its rank. The vocabulary must know every byte."""
    with open(path, "rb") as file:
        rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, file)))}
    pieces = [b""] * (max(rank_of.values()) + 1)
    for piece, rank in rank_of.items():
        pieces[rank] = piece
    if len(pieces) >= _LAST:
        raise ValueError("the vocabulary has too many tokens")
    byte_ids = [rank_of[bytes([b])] for b in range(256)]
    width = len(pieces)
    pairs = {rank_of[t[:i]] * width + rank_of[t[i:]]: rank for t, rank in rank_of.items()
             for i in range(1, len(t)) if t[:i] in rank_of and t[i:] in rank_of}
    return Ranks(pieces, byte_ids, *_perfect_hash(pairs))


def _perfect_hash(pairs: dict[int, int]) -> tuple[int, list[int], list[int], list[int]]:
    """Every key has a slot of its own: keys of one bucket are shifted together until all find free slots."""
    slots = (1 << max(8, (2 * len(pairs)).bit_length())) - 1  # odd, so that strides reach many slots
    buckets: dict[int, list[int]] = {}
    for key in pairs:
        buckets.setdefault(key % _BUCKETS, []).append(key)
    shifts, ranks, keys = [0] * _BUCKETS, [_NONE] * slots, [_NONE] * slots
    for bucket, members in sorted(buckets.items(), key=lambda b: -len(b[1])):
        for shift in range(1 << 20):
            places = [(k + shift * (1 + k % _STRIDES)) % slots for k in members]
            if len(set(places)) == len(places) and all(ranks[p] == _NONE for p in places):
                break
        else:
            raise ValueError("no place found for a group of pairs")
        shifts[bucket] = shift
        for key, place in zip(members, places):
            ranks[place], keys[place] = pairs[key], key
    return slots, shifts, ranks, keys


def _one_row(spark: SparkSession, rows: DataFrame, label: str) -> Column:
    """A one-row table, stored in the shared folder, as the value of a scalar subquery: read once and sent with tasks."""
    path = scratch_path(spark, label)
    rows.coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.select(F.struct(*stored.columns).alias("t")).scalar()


def rank_tables(spark: SparkSession, ranks: Ranks) -> Column:
    """The tables as one value, of a size that the vocabulary bounds."""
    rank_of = {piece: rank for rank, piece in enumerate(ranks.pieces)}
    bytes_first = [rank_of.get(bytes([a, b]), _LAST) for a in range(256) for b in range(256)]
    whole = pa.list_(pa.int32())
    packed = [_NONE if key == _NONE else key << _BITS | rank for key, rank in zip(ranks.keys, ranks.ranks)]
    table = pa.table({"byte_ids": pa.array([ranks.byte_ids], whole), "first": pa.array([bytes_first], whole),
                      "shifts": pa.array([ranks.shifts], whole), "packed": pa.array([packed], pa.list_(pa.int64())),
                      "pieces": pa.array([[p.hex() for p in ranks.pieces]], pa.list_(pa.string()))})
    return _one_row(spark, spark.createDataFrame(table), "bpe-ranks")


def _rank(tables: Column, ranks: Ranks, left: Column, right: Column) -> Column:
    """The rank of a pair of tokens, or ``_LAST``: a slot holds a pair above its rank, and may hold another pair or none."""
    def slot(key: Column) -> Column:
        shift = F.element_at(tables["shifts"], (key % _BUCKETS + 1).cast("int"))
        return ((key + shift * (key % _STRIDES + 1)) % ranks.slots + 1).cast("int")
    return let(left * len(ranks.pieces) + right, lambda key: let(F.element_at(tables["packed"], slot(key)), lambda entry: F.when(
        F.shiftright(entry, _BITS) == key, _id(entry)).otherwise(F.lit(_LAST).cast("long"))))


def fold_word(word: Column, tables: Column, ranks: Ranks) -> Column:
    """The token ids of one word: merges of lowest rank first, the leftmost of equals.

    The state is one array of longs: an id in the low bits, above it the first byte of its token, and above that the rank of
    its pair with the next id. So the least entry is the leftmost pair of the lowest rank, and no entry is there twice. A
    merge takes two places out, puts the merged id in, and looks up two ranks. When no pair has a rank, a negative number
    goes before the state, and the steps that are left do nothing. A word may have up to 2 ** 29 bytes.
    """
    single = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # one character a byte

    def fold(text: Column) -> Column:
        return let(F.transform(F.split(text, ""), lambda c: F.ascii(c)), lambda codes: F.transform(F.aggregate(
            F.sequence(F.lit(2), F.size(codes)), F.transform(codes, lambda a, i: _packed(
                F.when(i + 1 < F.size(codes), F.element_at(tables["first"], a * 256 + F.element_at(codes, F.least(i + 2, F.size(codes))) + 1))
                .otherwise(_LAST), F.shiftleft(i.cast("long"), _BITS), F.element_at(tables["byte_ids"], a + 1))),
            lambda state, _: F.when(F.element_at(state, 1) < 0, state).otherwise(let(F.array_min(state), lambda low: F.when(
                low >= _LAST << _RANK_AT, F.concat(F.array(F.lit(_NONE).cast("long")), state)).otherwise(
                _merge(state, low, tables, ranks)))), lambda state: F.when(F.element_at(state, 1) < 0, F.slice(
                    state, 2, F.size(state))).otherwise(state)), lambda e: _id(e).cast("int")))
    return F.when(F.octet_length(word) == 1, F.array(F.element_at(tables["byte_ids"], F.ascii(word) + 1))).otherwise(let(single, fold))


def _packed(rank: Column, place: Column, token: Column) -> Column:
    """An entry of a fold's state; ``place`` is the token's first byte, already in its bits."""
    return F.shiftleft(rank.cast("long"), _RANK_AT).bitwiseOR(place).bitwiseOR(token.cast("long"))


def _id(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(_LAST).cast("long"))


def _place(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(_PLACE).cast("long"))


def _merge(state: Column, least: Column, tables: Column, ranks: Ranks) -> Column:
    """Merge the pair of the least entry, whose rank is the merged token's id, and look up the ranks with its neighbours."""
    def at(low: Column, p: Column) -> Column:
        after = F.when(p + 1 < F.size(state), _packed(
            _rank(tables, ranks, low, _id(F.element_at(state, p + 2))), _place(least), low)).otherwise(
            _packed(F.lit(_LAST), _place(least), low))
        rest = F.slice(state, p + 2, F.size(state))
        return F.when(p > 1, let(F.element_at(state, p - 1), lambda x: F.concat(
            F.slice(state, F.lit(1), p - 2), F.array(_packed(_rank(tables, ranks, _id(x), low), _place(x), _id(x)), after), rest))
        ).otherwise(F.concat(F.array(after), rest))
    return let(F.shiftright(least, _RANK_AT), lambda low: let(
        F.array_position(state, least).cast("int"), lambda p: at(low, p)))


#: Classes of a pattern as they are within ASCII, and notations that the quicker library reads in another way.
_ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}
_OTHER_NOTATION = (r"\p", r"\P", "[:", "--", "&&", "||", "~~")


def word_cutter(pattern: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into words. ASCII texts go through a quicker library, with the pattern's letter and
    number classes spelt out, if it can read the pattern; the words are the same."""
    general = regex.compile(pattern).findall

    def spelt_out(part: str, inside: bool) -> str:
        for name, members in _ASCII_CLASSES.items():
            part = part.replace(name, members if inside else f"[{members}]")
        return part

    parts = re.split(r"(\[(?:\\.|[^\]\\])*\])", pattern)  # every second part is a class in brackets
    plain = "".join(spelt_out(p, i % 2 == 1) for i, p in enumerate(parts))
    if any(mark in plain for mark in _OTHER_NOTATION):
        return general
    try:
        ascii_only = re.compile(plain, re.ASCII).findall
    except re.error:
        return general
    return lambda text: ascii_only(text) if text.isascii() else general(text)


def _word_counts(pattern: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): how often each word occurs in a batch of texts, for words that the table may take."""
    split = word_cutter(pattern)
    for batch in batches:
        counts = Counter()
        for text in batch.column(0):
            counts.update(split(text.as_py()))
        words = [w for w in counts if len(w.encode()) <= FREQUENT_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, at most about ``most``: whole counts from the highest down, and of the count that
    does not fit whole the words whose hash is low enough."""
    capped = F.least("n", F.lit(_MOST_COUNT))
    sizes = counted.groupBy(capped.alias("c")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most _MOST_COUNT rows
    held, least, share = 0, _MOST_COUNT + 1, 0.0
    for row in sorted(sizes, key=lambda r: -r["c"]):
        if held + row["words"] > most:
            share = (most - held) / row["words"]
            break
        held, least = held + row["words"], row["c"]
    return counted.where((capped >= least) | ((capped == least - 1) & fraction_below(F.col("word"), F.lit(share))))


@dataclass(frozen=True)
class WordIds:
    """Where the ids of each frequent word begin (and one more), all their ids, and the tokens' bytes."""

    starts: np.ndarray
    ids: np.ndarray
    pieces: pa.Array


@dataclass(frozen=True)
class WordNumbers:
    """Frequent words in order of their numbers. Tasks that cut texts need these alone."""

    words: list[str]
    key: str

    def numbers(self) -> dict[str, int]:
        """Numbers of words, built once in a Python process."""
        if self.key not in _NUMBERS:
            _NUMBERS.clear()
            _NUMBERS[self.key] = {w: i for i, w in enumerate(self.words)}
        return _NUMBERS[self.key]


_NUMBERS: dict[str, dict[str, int]] = {}


def _cut(table: WordNumbers, pattern: str, names: list[str], source: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each text's words as codes, a frequent word's number or -1 - k for the k-th different other word, and those words.

    A batch leaves in steps of about STEP_WORDS words, so that no codes of a whole batch are held beside its texts.
    """
    split, number = word_cutter(pattern), table.numbers().get
    for batch in batches:
        texts, kept = batch.column(source), [batch.column(i) for i, n in enumerate(batch.schema.names) if n in names]
        start = 0
        while start < batch.num_rows:
            codes, code_ends, rare, rare_ends, stop = [], [0], [], [0], start
            while stop < batch.num_rows and code_ends[-1] < STEP_WORDS:
                words = split(texts[stop].as_py() or "")
                found = list(map(number, words))
                if None in found:
                    own: dict[str, int] = {}
                    found = [-1 - own.setdefault(w, len(own)) if c is None else c for w, c in zip(words, found)]
                    rare += own
                codes.append(np.array(found, np.int32))
                code_ends.append(code_ends[-1] + len(found))
                rare_ends.append(len(rare))
                stop += 1
            coded = pa.ListArray.from_arrays(pa.array(code_ends, pa.int32()), pa.array(np.concatenate(codes), pa.int32()))
            others = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(rare, pa.string()))
            yield pa.RecordBatch.from_arrays([*[c.slice(start, stop - start) for c in kept], coded, others], [*names, _CODES, _RARE])
            start = stop


def _joined(pieces: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the tokens between each two bounds: taken one after the other, they lie joined already."""
    if not len(ids):
        return pa.array([b""] * (len(bounds) - 1), pa.binary())
    taken = pieces.take(pa.array(ids))
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int32)[taken.offset:taken.offset + len(ids) + 1]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds]), data])


def _put_together(table: WordIds, names: list[str], coded: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace codes and folded words by the ids in order and the bytes they stand for."""
    for batch in batches:
        n, start = batch.num_columns, 0
        while start < batch.num_rows:
            ends = batch.column(n - 2).offsets.to_numpy()
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + STEP_WORDS, side="right")) - 1)
            part = batch.slice(start, min(stop, batch.num_rows) - start)
            start += part.num_rows
            code_list, folded = part.column(n - 2), part.column(n - 1)
            codes, words = code_list.flatten().to_numpy().astype(np.int64), folded.flatten()
            counts = np.diff(code_list.offsets.to_numpy())
            before = folded.offsets.to_numpy()[:-1] - folded.offsets.to_numpy()[0]
            # One table: the frequent words' ids, and behind them those of this part's other words.
            own_starts = words.offsets.to_numpy() - (words.offsets.to_numpy()[0] if len(words.offsets) else 0)
            starts = np.concatenate([table.starts[:-1], len(table.ids) + own_starts])
            ids = np.concatenate([table.ids, words.flatten().to_numpy().astype(np.int32)])
            place = np.where(codes < 0, len(table.starts) - 1 + np.repeat(before, counts) - 1 - codes, codes)
            sizes = np.concatenate([np.diff(table.starts), np.diff(own_starts)])[place]
            out_ends = np.append(0, np.cumsum(sizes))
            out = ids[np.repeat(starts[place] - out_ends[:-1], sizes) + np.arange(out_ends[-1])]
            bounds = out_ends[np.append(0, np.cumsum(counts))]
            both = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out)),
                                               _joined(table.pieces, out, bounds)], ["ids", "decoded"])
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n - 2)], both], [*names, coded])


class ByteBpe:
    """Encoder and decoder of documents. The rank tables are a column of their own below the folds: subqueries may not stand
    inside lambda functions, and the optimizer puts the value in where it is used."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str) -> None:
        self.spark, self.pattern, self.ranks = spark, pattern, read_ranks(ranks_path)
        self._tables = rank_tables(spark, self.ranks)
        self.pieces = pa.array(self.ranks.pieces, pa.binary())
        self.words, self.word_ids = WordNumbers([], ""), WordIds(np.zeros(1, np.int64), np.zeros(0, np.int32), self.pieces)

    def _folded(self, rows: DataFrame, word: str, ids: str) -> DataFrame:
        """``rows`` with the ids of a column of words, or of a column of lists of words."""
        one = isinstance(rows.schema[word].dataType, T.StringType)
        fold = (lambda t: fold_word(F.col(word), t, self.ranks)) if one else (
            lambda t: F.transform(F.col(word), lambda w: fold_word(w, t, self.ranks)))
        return rows.withColumn(_TABLES, self._tables).withColumn(ids, let(F.col(_TABLES), fold)).drop(_TABLES)

    def learn_frequent_words(self, texts: DataFrame, sample: int = WORD_SAMPLE) -> None:
        """Fold the most frequent words of about ``sample`` rows of (key, text) beforehand.

        Ids never depend on this table: it has at most FREQUENT_WORDS words, and documents fold their other words.
        """
        total, pattern = texts.count(), self.pattern
        chosen = texts.where(fraction_below(F.col("key"), F.lit(min(1.0, sample / max(total, 1))))).select(F.coalesce("text", F.lit("")))
        counted = durable(chosen.mapInArrow(lambda b: _word_counts(pattern, b), "word string, n long")
                          .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
        path = scratch_path(self.spark, "bpe-words")
        self._folded(_frequent(counted, FREQUENT_WORDS), "word", "ids").select("word", "ids").write.parquet(path)
        found = self.spark.read.parquet(path).toArrow().combine_chunks()  # at most FREQUENT_WORDS rows of bounded size
        ids = found.column("ids").combine_chunks()
        self.words = WordNumbers(found.column("word").to_pylist(), path)
        self.word_ids = WordIds(ids.offsets.to_numpy().astype(np.int64), ids.flatten().to_numpy().astype(np.int32), self.pieces)

    def encode(self, docs: DataFrame, text: str, coded: str = "coded", keep_text: bool = True, stored: bool = False) -> DataFrame:
        """``docs`` with a struct of ``ids``, the token ids of a text without special tokens, and ``decoded``, the bytes
        they decode to. A NULL text is empty.

        ``stored`` writes the words' codes and folded ids to the shared folder in between: a task then needs one Python
        worker at a time instead of two, for some disk and time.
        """
        words, word_ids = map(self.spark.sparkContext.broadcast, (self.words, self.word_ids))
        names, pattern = [c for c in docs.columns if c != coded and (keep_text or c != text)], self.pattern
        source, kept = docs.columns.index(text), [docs.schema[c] for c in names]
        schema = T.StructType([*kept, T.StructField(_CODES, T.ArrayType(T.IntegerType())), T.StructField(_RARE, T.ArrayType(T.StringType()))])
        cut = docs.mapInArrow(lambda b: _cut(words.value, pattern, names, source, b), schema)
        folded = self._folded(cut, _RARE, _FOLDED).select(*[F.col(quoted(c)) for c in names], _CODES, _FOLDED)
        if stored:
            path = scratch_path(self.spark, "bpe-codes")
            folded.write.parquet(path)
            folded = self.spark.read.parquet(path)
        both = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
        return folded.mapInArrow(lambda b: _put_together(word_ids.value, names, coded, b),
                                 T.StructType([*kept, T.StructField(coded, both)]))

    def decode(self, docs: DataFrame, ids: str, decoded: str = "decoded") -> DataFrame:
        """``docs``, a stored table, with the bytes of its token ids, joined."""
        def joined(t: Column) -> Column:
            return F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.element_at(t["pieces"], i + 1)), ""))
        return docs.withColumn(_TABLES, self._tables).withColumn(decoded, let(F.col(_TABLES), joined)).drop(_TABLES)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                     sample: int = WORD_SAMPLE) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every text and the bytes they decode to.

    NULL texts are empty: no ids, no bytes. Rows that repeat stay; texts are read whole; an empty table gives an empty
    table; other columns are not read.
    """
    coder = ByteBpe(docs.sparkSession, ranks_path, pattern)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    coder.learn_frequent_words(rows.select(F.col("doc_id").alias("key"), "text"), sample)
    return coder.encode(rows, "text", keep_text=False).select("doc_id", "coded.ids", "coded.decoded")
