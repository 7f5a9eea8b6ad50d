"""Ranked lexical search: the documents with the highest impact sums for each query, exactly, by interval bounds.

One pass turns documents into postings of the queries' terms, stored; their counts give each term's weight. Documents
are dealt into blocks of about as many postings each. In a block, every posting list has a sparse table for the place of the
maximum in any range of it. A query starts with the interval of all the block's documents. The bound of an interval is the
sum, over the query's terms, of the range maximum of the term's list; the interval with the highest bound is taken
first, split at the document where the term that adds most has its maximum, that document is scored, and both halves
are bounded anew. A block is done when no interval can hold a document that ranks before its tenth. Intervals are
taken some hundred at a time, so that the look-ups are array operations. The blocks' best are ranked together at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..session import scratch_path

#: Scales of weights and impacts, and how much a document's length counts, in hundredths.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 90
#: About so many postings make a block; so many query terms are searched at a time; so many look-ups are one step.
BLOCK_POSTINGS, QUERY_TERMS, STEP_LOOKUPS = 1_000_000, 1_000_000, 1 << 15
_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"
_FOUND = "item int, doc_id long, score long"
#: Bytes that part terms, and A-Z, as a table for ``bytes.translate``; all of UTF-8's other bytes belong to terms.
_FOLD = bytes(32 if b < 0x80 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included: runs of ASCII letters and digits and of all other characters
    beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Queries:
    """Queries as one array: the terms of query ``q`` are ``terms[starts[q]:starts[q + 1]]``, numbers into the vocabulary."""

    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray


def _posting_batches(vocabulary: Broadcast, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = vocabulary.value
    for batch in batches:
        sizes, starts, terms, tfs = [], [0], [], []
        for text in batch.column(1):
            words = terms_of(text.as_py())
            sizes.append(len(words))
            found = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
            terms += [t for t, _ in found]
            tfs += [c for _, c in found]
            starts.append(len(terms))
        offsets = pa.array(starts, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])


class Block:
    """Posting lists of one block of documents, one after the other, each by document, with one sparse table over all."""

    def __init__(self, docs: np.ndarray, n_docs: int, terms: np.ndarray, factors: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((docs, terms))
        self.n_docs, self.factors = n_docs, factors[order]
        self.docs = docs[order].astype(np.int64)
        self.keys = terms[order].astype(np.int64) * (n_docs + 1) + self.docs
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        longest = int(np.diff(self.starts).max(initial=0))
        # places[j][i] is where the maximum of the 2**j postings from i on stands, the first of equals; a range never
        # leaves its list, so it does not matter that entries near a list's end look into the next.
        self.places = [np.arange(len(order), dtype=np.int32)]
        while 2 << len(self.places) - 1 <= longest:
            half, before = 1 << len(self.places) - 1, self.places[-1]
            left, right = before[:-half], before[half:]
            self.places.append(np.where(self.factors[left] >= self.factors[right], left, right))
        self.widths = np.array([len(p) for p in self.places])
        self.table = np.concatenate(self.places) if len(order) else np.zeros(0, np.int32)
        self.bases = np.concatenate([[0], np.cumsum(self.widths)[:-1]])

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the maximum of each non-empty range of postings, low included and high not; -1 for empty ones."""
        length = high - low
        some = length > 0
        level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
        base = self.bases[level]
        left = self.table[np.where(some, base + low, 0)]
        right = self.table[np.where(some, base + high - (1 << level), 0)]
        return np.where(some, np.where(self.factors[left] >= self.factors[right], left, right), -1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document places, scores) of a query's k best documents: score down, then place up."""
        lists = np.flatnonzero(self.starts[terms + 1] > self.starts[terms])
        terms, weights = terms[lists], weights[lists]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = terms.astype(np.int64) * (self.n_docs + 1)
        step = max(1, STEP_LOOKUPS // len(terms))
        best_docs, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = np.array([0], np.int64), np.array([self.n_docs], np.int64)
        bound, split = self._bounded(base, weights, self.starts[terms][None, :], self.starts[terms + 1][None, :])
        while len(left):
            order = np.lexsort((left, -bound))
            taken, rest = order[:step], order[step:]
            l, r, m = left[taken], right[taken], split[taken]
            at = np.searchsorted(self.keys, base[None, :] + m[:, None])
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == base[None, :] + m[:, None]
            scores = np.where(there, self.factors[np.minimum(at, len(self.keys) - 1)] * weights[None, :], 0).sum(axis=1)
            best_docs, best_scores = np.concatenate([best_docs, m]), np.concatenate([best_scores, scores])
            keep = np.lexsort((best_docs, -best_scores))[:k]
            best_docs, best_scores = best_docs[keep], best_scores[keep]
            low = np.searchsorted(self.keys, base[None, :] + l[:, None])
            high = np.searchsorted(self.keys, base[None, :] + r[:, None])
            # Both halves: the documents before the split one, and those behind it.
            child_left, child_right = np.concatenate([l, m + 1]), np.concatenate([m, r])
            child_bound, child_split = self._bounded(base, weights, np.concatenate([low, at + there]), np.concatenate([at, high]))
            left, right = np.concatenate([left[rest], child_left]), np.concatenate([right[rest], child_right])
            bound, split = np.concatenate([bound[rest], child_bound]), np.concatenate([split[rest], child_split])
            open_ = bound > 0
            if len(best_docs) == k:  # an interval stays that can hold a better document, or an equal one that comes before
                open_ &= (bound > best_scores[-1]) | ((bound == best_scores[-1]) & (left < best_docs[-1]))
            left, right, bound, split = left[open_], right[open_], bound[open_], split[open_]
        return best_docs, best_scores

    def _bounded(self, base: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of intervals, given as ranges in each term's list, and the document to split each at."""
        places = self.maxima(low, high)
        parts = np.where(places >= 0, self.factors[places] * weights[None, :], 0)
        first = parts.argmax(axis=1)
        return parts.sum(axis=1), self.docs[places[np.arange(len(parts)), first]]


def _length_weight(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // total


def _search_block(queries: Broadcast, weights: np.ndarray, n_docs: int, total: int, k: int, table: pa.Table) -> pa.Table:
    asked = queries.value
    order = table.sort_by([("missing", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    ids = order.column("doc_id")
    sizes = order.column("n").to_numpy()
    lists, tfs = order.column("terms").combine_chunks(), order.column("tfs").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    docs = np.repeat(np.arange(len(sizes)), counts)
    tf = tfs.flatten().to_numpy()
    factors = IMPACT_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * _length_weight(sizes, n_docs, total)[docs])
    block = Block(docs, len(sizes), lists.flatten().to_numpy(), factors, len(weights))
    items, places, scores = [], [], []
    for q in range(len(asked.starts) - 1):
        terms = asked.terms[asked.starts[q]:asked.starts[q + 1]]
        found, score = block.best(terms, weights[terms], k)
        positive = score > 0
        items += [q] * int(positive.sum())
        places.append(found[positive])
        scores.append(score[positive])
    where = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
    return pa.table({"item": pa.array(items, pa.int32()), "doc_id": ids.take(where).combine_chunks() if len(where) else pa.array([], pa.int64()),
                     "score": pa.array(np.concatenate(scores) if scores else [], pa.int64())})


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", query_terms: int = QUERY_TERMS,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each row of ``items``.

    A NULL or empty text has no term; such an item finds nothing, such a document is never found. Equal scores are
    ranked by doc_id, rows without one last; rows that repeat are documents of their own. An item id that repeats is
    searched once per row of it and the answers share the id. Empty tables give an empty table; other columns are not read.
    Items are searched in groups of at most about ``query_terms`` different terms (an item is never parted).
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    asked = items.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(item_text)).alias("text"))
    kind = asked.schema["item_id"].dataType
    answers = [_search_group(spark, narrow, group, kind, k, block_postings) for group in _groups(asked, query_terms)]
    if not answers:
        return items.select(F.col(quoted(item_id)).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, answers)


def _groups(items: DataFrame, query_terms: int) -> Iterator[list[tuple]]:
    """Items in groups that hold a bounded number of terms, read one after the other."""
    group, held = [], 0
    for row in items.where("text is not null").toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if group and held + len(terms) > query_terms:
            yield group
            group, held = [], 0
        group.append((row["item_id"], terms))
        held += len(terms)
    if group:
        yield group


def _search_group(spark, docs: DataFrame, group: list[tuple], kind: T.DataType, k: int, block_postings: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    numbered = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms] for _, terms in group]
    queries = Queries(vocabulary, np.cumsum([0, *map(len, numbered)]), np.array([t for terms in numbered for t in terms], np.int64))
    shared = spark.sparkContext.broadcast(vocabulary)  # at most QUERY_TERMS terms and one item's
    path = scratch_path(spark, "postings")
    docs.mapInArrow(lambda batches: _posting_batches(shared, batches), _POSTINGS).where("n > 0").write.parquet(path)
    postings = spark.read.parquet(path)
    n_docs, total, held = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))
    asked = spark.sparkContext.broadcast(queries)
    blocks = max(1, math.ceil(held / block_postings))
    # Dealt by the place in the stored table: copies of a document spread over all blocks.
    dealt = (postings.where(F.size("terms") > 0).withColumn("missing", F.col("doc_id").isNull())
             .withColumn("block", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(blocks)).cast("int")))
    found = dealt.groupBy("block").applyInArrow(lambda t: _search_block(asked, weights, n_docs, total, k, t), _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    names = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(group)], schema))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
