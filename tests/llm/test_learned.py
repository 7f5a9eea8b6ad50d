import zlib

import numpy as np
from pyspark.sql import functions as F

from smelter.llm import language, toxicity
from smelter.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_languages_of_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, SMALL).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (remainder(r["doc_id"]) == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and any(map(str.isalpha, docs[r["doc_id"]]["text"] or ""))]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]
    assert sum(right) / len(right) > 0.95


def test_language_of_odd_texts(spark, make_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    model = language.train(docs, per_language=60)
    assert language.LanguageModel.predict(model, "der die und " * 200000)[0] == "de"
    odd = make_docs([(1, None), (2, ""), (3, "123 ... \n"), (4, "le la les une dans"), (4, "le la les une dans"), (None, "the and of")])
    odd = odd.withColumns({"held_out": F.lit("x"), "score": F.lit("y"), "lang": F.lit("zz")})
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in language.identify(odd, model).collect()))
    assert got[1:4] == [(1, "und"), (2, "und"), (3, "und")] and got[4] == got[5] and len(got) == 6
    assert language.identify(odd.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.train(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_chunks_of_a_long_text_count_every_gram(monkeypatch):
    text = "abc dé fgh " * 40
    whole = language.gram_buckets(text)
    monkeypatch.setattr(language, "_CHUNK", 7)
    assert (language.gram_buckets(text) == whole).all() and whole.sum() == 3 * (len(text.strip()) + 2) - 3


def test_weights_are_sparse_and_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    model = language.ElasticNetLeader(50, 2)
    for _ in range(400):
        label = int(rng.integers(2))
        at = np.array([label, *rng.choice(np.arange(2, 50), 3, replace=False)])
        model.learn(at, np.full(4, 0.5), label)
    weights = model.weights()
    assert abs(weights[0, 0] - weights[0, 1]) > 1 and (weights[2:] == 0).mean() > 0.3
    scores = np.array([[4.0, 0.0]] * 60 + [[4.0, 0.0]] * 40)
    labels = np.array([0] * 60 + [1] * 40)
    assert language.fit_temperature(scores, labels) > 5 and language.fit_temperature(scores[:0], labels[:0]) == 1.0


def test_toxicity_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(r["held_out"] == (remainder(r["doc_id"]) == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = [p for p, t in held if t == 1]
    clean = [p for p, t in held if t == 0]
    assert sum(caught) / len(caught) > 0.9 and sum(clean) / len(clean) < 0.02


def test_composed_grammar_walks_like_its_parts():
    parts = [toxicity.scope(toxicity.NEGATION, 2, (toxicity.INSULT,), 0.5), toxicity.scope(toxicity.TARGET, 3, (toxicity.INSULT,), 2.0)]
    both = toxicity.compose(*parts)
    rng = np.random.default_rng(2)
    for _ in range(50):
        symbols = [toxicity.SYMBOLS[i] for i in rng.integers(len(toxicity.SYMBOLS), size=12)]
        state, states = 0, [0, 0]
        for symbol in symbols:
            state, out, weight = both.step(state, symbol)
            expected, between = 0.0, symbol
            for i, part in enumerate(parts):
                states[i], between, w = part.step(states[i], between)
                expected += w
            assert (out, round(weight, 9)) == (between, round(expected, 9))


def test_clauses_weigh_their_context():
    model = toxicity.ToxicityModel()

    def clause(text):
        return model.clause_score(toxicity._WORD.findall(text))
    assert clause("you are an idiot") > clause("an idiot") > clause("she said an idiot") > 0
    assert clause("you are not an idiot") < clause("you are an idiot")
    assert clause("we will kill you") > 0 and clause("you we will kill") > clause("kill the process")
    assert clause("a fine day") == 0 and model.features(None) == (0.0, 0.0, 0.0)


def test_toxicity_of_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "an idiot and a moron. " * 50000), (4, "fine words"), (4, "fine words"), (None, "scum")])
    docs = docs.withColumns({"score": F.lit("x"), "toxic": F.lit("y"), "doc": F.lit("z"), "id": F.lit("i")})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert model.weights == {}
    rows = {(r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    assert (3, 1) in rows and {(1, 0), (2, 0), (4, 0)} <= rows
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 3 not in {r["doc_id"] for r in kept.collect()} and kept.where("doc_id = 4").count() == 2
    assert toxicity.score(docs.limit(0), model).count() == 0
    few = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs.drop("toxic", "id"), few).calibration == toxicity.ToxicityModel().calibration
