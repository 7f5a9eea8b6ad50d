"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into symbols: insult, threat, target, negation, reported speech. Four transducers rewrite the
symbols of a clause: negation weakens what stands in its scope, reported speech weakens what follows it, a target
strengthens an insult or threat near it, and a threat without a target is weakened. They are composed into one
transducer once; a clause is then one walk through it. A clause's score adds the lexical weights of its insults and
threats, each times the weight its path gives it. A document's probability is a logistic function of its clauses.

The lexicon has fixed general words and learns further words and word stems from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, held_out

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)

# General words of the grammar, for the languages it knows.
FIXED_WORDS = {
    INSULT: ("idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown clowns disgusting dumb fool "
             "fools imbecile jerk jerks filthy vermin garbage cretin dimwit coward freak ugly idiotisch dumm dummkopf "
             "abschaum versager widerlich imbécile débile ordure minable abruti idiota estúpido estúpida imbécil basura "
             "asqueroso patético").split(),
    THREAT: "kill murder hurt destroy shoot stab strangle töten umbringen tuer frapper matar".split(),
    TARGET: ("you your yours yourself he she they them him her his their those these people everyone du dich dir ihr euch "
             "sie tu toi te vous ils elle usted ustedes tú ellos").split(),
    NEGATION: "not no never neither nor isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás".split(),
    REPORT: "said says say called calls quoted wrote claims claimed reportedly sagte sagt dit disait dijo dice".split(),
}
#: What a fixed insult or threat weighs before there is evidence, and how many documents that is worth.
PRIOR_WEIGHT, PRIOR_DOCUMENTS = 3.0, 3.0
#: The lexicon and the calibration learn from about this many labelled documents of each class, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Of these, one in so many sets the calibration instead of the lexicon.
CALIBRATION_EVERY = 4
STEM_LENGTHS = (4, 5, 6, 7)
#: A learned form must be this unlikely (natural log) to be as toxic as it is by chance, and be in so many documents.
LOG_CHANCE, LEAST_DOCUMENTS = -11.5, 3
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_CACHE = 1 << 16


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over ``SYMBOLS``: (state, symbol) -> (next state, symbol, log weight).

    A missing arc stays in the state and passes the symbol on.
    """

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    states: int

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def scope(trigger: str, reach: int, changed: Iterable[str], weight: float) -> Transducer:
    """After ``trigger``, symbols of ``changed`` weigh ``weight`` times as much for ``reach`` more words."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for left in range(reach + 1):
        for symbol in SYMBOLS:
            change = math.log(weight) if left and symbol in changed else 0.0
            arcs[left, symbol] = (reach if symbol == trigger else max(left - 1, 0), symbol, change)
    return Transducer(arcs, reach + 1)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Run ``second`` on what ``first`` puts out: states are pairs, weights multiply."""
    arcs = {}
    for a in range(first.states):
        for b in range(second.states):
            for symbol in SYMBOLS:
                a_next, between, a_weight = first.step(a, symbol)
                b_next, out, b_weight = second.step(b, between)
                arcs[a * second.states + b, symbol] = (a_next * second.states + b_next, out, a_weight + b_weight)
    return Transducer(arcs, first.states * second.states)


def grammar() -> Transducer:
    """negation . reported speech . target . threat; it starts a clause in state 0."""
    hits = (INSULT, THREAT)
    parts = [scope(NEGATION, 3, hits, 0.3), scope(REPORT, 12, hits, 0.5), scope(TARGET, 4, hits, 1.5)]
    bare_threat = Transducer({(0, THREAT): (0, THREAT, math.log(0.4)), (0, TARGET): (1, TARGET, 0.0),
                              (1, THREAT): (1, THREAT, 0.0)}, 2)
    return reduce(compose, [*parts, bare_threat])


@dataclass
class ToxicityModel:
    """Learned forms (``stem*`` or a whole word) with weights, and the calibration. Its size is bounded by the sample."""

    weights: dict[str, float] = field(default_factory=dict)
    calibration: tuple[float, ...] = (-4.0, 0.8, 0.4, 0.4)

    def __post_init__(self) -> None:
        self._fixed = {w: kind for kind, words in FIXED_WORDS.items() for w in words}
        machine = grammar()
        self._walk = {key: (to, math.exp(w)) for key, (to, _, w) in machine.arcs.items()}
        self._symbol = lru_cache(_CACHE)(self._look_up)

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.calibration)

    def _look_up(self, word: str) -> tuple[str, float]:
        """The longest form that covers the word decides."""
        kind = self._fixed.get(word)
        if word in self.weights:
            return kind or INSULT, self.weights[word]
        if kind:
            return kind, PRIOR_WEIGHT if kind in (INSULT, THREAT) else 0.0
        for n in reversed(STEM_LENGTHS):
            if len(word) > n and (stem := word[:n] + "*") in self.weights:
                return INSULT, self.weights[stem]
        return OTHER, 0.0

    def clause_score(self, words: Iterable[str]) -> float:
        state, score = 0, 0.0
        for word in words:
            symbol, weight = self._symbol(word)
            state, factor = self._walk[state, symbol]
            score += weight * factor
        return score

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log1p of the best clause, of all clauses, and of all clauses per thousand words."""
        plain = (text or "").lower()
        words = _WORD.findall(plain)
        symbol = self._symbol
        if not any(symbol(w)[1] for w in set(words)):
            return 0.0, 0.0, 0.0
        best = total = 0.0
        for clause in _CLAUSE.finditer(plain):
            score = self.clause_score(_WORD.findall(clause.group()))
            total += score
            best = max(best, score)
        total = max(total, 0.0)
        return math.log1p(max(best, 0.0)), math.log1p(total), math.log1p(1000.0 * total / len(words))

    def score(self, features: Iterable[float]) -> float:
        z = self.calibration[0] + sum(c * x for c, x in zip(self.calibration[1:], features))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def forms(words: Iterable[str]) -> set[str]:
    found = set(words)
    return found | {w[:n] + "*" for w in found for n in STEM_LENGTHS if len(w) > n}


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents of the task each form stands."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(forms(_WORD.findall(text.lower())))
    names = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()),
                                      pa.array([counts[0][n] for n in names], pa.int64())], ["form", "toxic", "clean"])


def _evidence(toxic: float, clean: float, all_toxic: int, all_clean: int) -> tuple[float, float]:
    """Log odds of a form (toxic against clean documents), and its standard error."""
    odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    return odds, math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _chance(toxic: int, clean: int, share: float) -> float:
    """A bound on the log probability that so many of a form's documents are toxic by chance."""
    n, p = toxic + clean, toxic / (toxic + clean)
    if p <= share:
        return 0.0
    return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def learn_lexicon(counts: DataFrame, all_toxic: int, all_clean: int) -> dict[str, float]:
    """Weights of fixed insults and threats with evidence, and of forms that are significantly toxic."""
    fixed = [w for kind in (INSULT, THREAT) for w in FIXED_WORDS[kind]]
    others = {w for kind in (TARGET, NEGATION, REPORT) for w in FIXED_WORDS[kind]}
    share = (all_toxic + 1) / (all_toxic + all_clean + 2)
    least_share = F.col("toxic") / (F.col("toxic") + F.col("clean")) > share
    rows = counts.where(F.col("form").isin(fixed) | ((F.col("toxic") >= LEAST_DOCUMENTS) & least_share
                                                     & (F.col("toxic") * math.log(share) <= LOG_CHANCE))).collect()
    learned: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["form"]), r["form"])):
        form, n = r["form"], r["toxic"] + r["clean"]
        odds, error = _evidence(r["toxic"], r["clean"], all_toxic, all_clean)
        if form in fixed:
            learned[form] = max(0.0, (PRIOR_WEIGHT * PRIOR_DOCUMENTS + odds * n) / (PRIOR_DOCUMENTS + n))
        elif form not in others and odds > 1.64 * error and _chance(r["toxic"], r["clean"], share) <= LOG_CHANCE:
            weight = odds - 1.64 * error
            word = form.rstrip("*")
            shorter = [learned[s] for n in STEM_LENGTHS if n < len(word) and (s := word[:n] + "*") in learned]
            if weight >= 1.0 and not (shorter and max(shorter) >= weight - 1.0):
                learned[form] = weight
    return learned


def calibrate(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps; too few of a class leave the defaults."""
    if min(toxic.sum(), (1 - toxic).sum()) < 5:
        return ToxicityModel().calibration
    x, w = np.column_stack([np.ones(len(features)), features]), np.zeros(4)
    penalty = ridge * np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(4), x.T @ (toxic - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _feature_batches(model: ToxicityModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found.T), batch.column(1)], ["best", "total", "rate", "toxic"])
    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold. Other columns are never read.

    A document labelled more than once is toxic if any label says so; labels other than 0 and 1 count by sign. Without
    labels the fixed words and default calibration remain.
    """
    marked = (labels.where((fold(F.col(doc_id)) != 0) & F.col(toxic).isNotNull())
              .groupBy(F.col(doc_id).alias("id")).agg((F.max(F.col(toxic).cast("int")) > 0).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    if not sizes:
        return ToxicityModel()
    share = F.when(F.col("toxic") == 1, min(1.0, sample_toxic / max(sizes.get(1, 0), 1))).otherwise(
        min(1.0, sample_clean / max(sizes.get(0, 0), 1)))
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("toxicity")), F.lit(1 << 30))
    sample = (marked.where(drawn < F.ceil(share * (1 << 30)))
              .withColumn("lexicon", F.pmod(F.xxhash64("id"), F.lit(CALIBRATION_EVERY)) != 0))
    # Bounded by the two sample sizes, whatever the corpus.
    texts = (docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
             .join(F.broadcast(sample), "id"))
    counts = (texts.where("lexicon").select("text", "toxic").mapInArrow(_count_batches, "form string, toxic long, clean long")
              .groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    lexicon_sizes = {r["toxic"]: r["count"] for r in sample.where("lexicon").groupBy("toxic").count().collect()}
    model = ToxicityModel(learn_lexicon(counts, lexicon_sizes.get(1, 0), lexicon_sizes.get(0, 0)))
    rows = (texts.where("not lexicon").select("text", "toxic")
            .mapInArrow(_feature_batches(model), "best double, total double, rate double, toxic int").collect())
    found = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, 4)
    return ToxicityModel(model.weights, calibrate(found[:, :3], found[:, 3]))


def _score_batches(model: ToxicityModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(model.features(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])
    return run


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text; ``predicted`` is 1 from a score of 0.5.

    Only the text decides. NULL and empty texts get the score of a text without hits. Rows that repeat stay; texts are
    read whole; an empty table gives an empty table.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                         F.col(text).alias("text"))
    scored = narrow.mapInArrow(_score_batches(model), "doc_id long, held_out boolean, text string, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays below ``threshold``, all columns unchanged."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([*whole.schema.fields, T.StructField("score", T.DoubleType())])
    return whole.mapInArrow(_score_batches(model), schema).where(F.col("score") < threshold).select("doc.*")
