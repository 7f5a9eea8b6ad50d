"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training text. The classifier learns from a bounded sample per language by
follow-the-regularised-leader with an elastic net, which leaves most weights at zero; a temperature fitted on documents
that the weights have not seen calibrates its probabilities. Prediction reads whole texts in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import fold, held_out

BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
#: The classifier learns from about this many documents of each language, at most; all if there are fewer.
PER_LANGUAGE = 2000
#: Of these, one in so many sets the temperature instead of the weights.
CALIBRATION_EVERY = 5
UNDETERMINED = "und"
_CHUNK = 1 << 16
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def gram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each hashed n-gram occurs. Letters are lower-cased, every run of other characters is one blank.
    The text is read in chunks that overlap by the longest n-gram, so memory stays bounded."""
    counts = np.zeros(buckets, dtype=np.int64)
    plain = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    longest = max(GRAMS)
    for at in range(0, len(codes), _CHUNK):
        part = codes[at:at + _CHUNK + longest - 1].astype(np.uint64)
        starts = min(_CHUNK, len(codes) - at)
        mixed = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            mixed = mixed[:len(part) - n + 1] * _MIX[0] + part[n - 1:] * _MIX[1] + np.uint64(n)
            if n in GRAMS:
                hashed = (mixed[:starts] ^ (mixed[:starts] >> np.uint64(15))) * _MIX[2]
                slots = ((hashed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                counts += np.bincount(slots, minlength=buckets)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the non-zero features, at unit length."""
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    length = np.sqrt((values ** 2).sum())
    return at, (values / length if length else values)


@dataclass(frozen=True)
class LanguageModel:
    """Weights of a bounded size: buckets x languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return _softmax(values @ self.weights[at] / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = self.probabilities(*tf_idf(gram_buckets(text, len(self.idf)), self.idf))
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class ElasticNetLeader:
    """Follow the regularised leader, per coordinate, with L1 and L2 penalties, for all classes at once."""

    def __init__(self, features: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.5,
                 l2: float = 0.2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int, importance: float = 1.0) -> None:
        w = self.weights(at)
        error = _softmax(values @ w)
        error[label] -= 1.0
        gradient = values[:, None] * error[None, :] * importance
        grown = self.n[at] + gradient ** 2
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        z = scores / np.exp(log_t)
        top = z.max(axis=1)
        return float((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(z)), labels]).mean())
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _train_one(languages: list[str], idf: np.ndarray, epochs: int):
    """The sample is bounded by PER_LANGUAGE documents a language and BUCKETS features a document."""
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("at").to_numpy(), kind="stable")
        labels = np.array([languages.index(x) for x in rows.column("lang").to_pylist()], dtype=np.int64)
        found = [(np.array(a, dtype=np.int64), np.array(c)) for a, c in
                 zip(rows.column("buckets").to_pylist(), rows.column("counts").to_pylist())]
        features = []
        for at, counts in found:
            values = np.log1p(counts) * idf[at]
            length = np.sqrt((values ** 2).sum())
            features.append((at, values / length if length else values))
        kept = [i for k, i in enumerate(order) if k % CALIBRATION_EVERY or len(order) < 2 * CALIBRATION_EVERY]
        rest = sorted(set(order.tolist()) - set(kept))
        size = np.bincount(labels[kept], minlength=len(languages)).astype(float)
        importance = len(kept) / (len(languages) * np.maximum(size, 1.0))
        model = ElasticNetLeader(len(idf), len(languages))
        for _ in range(epochs):
            for i in kept:
                model.learn(*features[i], labels[i], importance[labels[i]])
        weights = model.weights()
        scores = np.array([features[i][1] @ weights[features[i][0]] for i in rest]).reshape(len(rest), len(languages))
        return pa.table({"weights": pa.array([weights.ravel().tolist()], pa.list_(pa.float64())),
                         "temperature": pa.array([fit_temperature(scores, labels[rest])])})
    return run


def _frequency_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of each task: BUCKETS numbers, whatever it read."""
    total, texts = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += gram_buckets(text) > 0
            texts += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(total, texts))], ["bucket", "n"])


def _feature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [gram_buckets(t) for t in batch.column(2).to_pylist()]
        at = [np.flatnonzero(c) for c in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.tolist() for a in at], pa.list_(pa.int32())),
             pa.array([c[a].tolist() for c, a in zip(found, at)], pa.list_(pa.int64()))], ["at", "lang", "buckets", "counts"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, epochs: int = 3) -> LanguageModel:
    """Learn from the text and language of documents outside the held-out fold; other columns are never read.

    Texts without a letter teach nothing. Languages are those of the training documents, in order.
    """
    rows = (docs.where((fold(F.col(doc_id)) != 0) & F.col(lang).isNotNull() & F.rlike(text, F.lit(r"\p{L}")))
            .select(F.xxhash64(doc_id, text).alias("at"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items()
                                        for x in (name, min(1.0, per_language / n))]), F.col("lang"))
    chosen = F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < F.ceil(share * (1 << 30))
    frequency = rows.select("text").mapInArrow(_frequency_batches, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows
    seen = np.zeros(BUCKETS + 1)
    for r in frequency:
        seen[r["bucket"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1.0
    sample = durable(rows.where(chosen).mapInArrow(
        _feature_batches, "at long, lang string, buckets array<int>, counts array<long>"))
    fitted = (sample.groupBy(F.lit("all")).applyInArrow(_train_one(languages, idf, epochs),
                                                    "weights array<double>, temperature double").first())
    return LanguageModel(languages, idf, np.array(fitted["weights"]).reshape(BUCKETS, len(languages)), fitted["temperature"])


def _prediction_batches(model: LanguageModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every text, and its calibrated probability.

    Only the text decides. NULL texts and texts without a letter are ``und`` with score 0, and so is every text if the
    model knows no language. Ties go to the first language by name. Rows that repeat stay; an empty table gives an
    empty table; texts are read whole.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                         F.col(text).alias("text"))
    return narrow.mapInArrow(_prediction_batches(model), "doc_id long, held_out boolean, lang_pred string, score double")
