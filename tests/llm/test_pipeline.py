from collections import Counter

import corpus_pipeline
from smelter.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order_and_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(number))
        before = docs
        stage(spark, docs, SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        sizes.append(docs.count())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
            kept = {r["doc_id"] for r in docs.collect()}
            assert len(toxic & kept) <= len(toxic) / 2 and sizes[-1] > 0.85 * sizes[-2]
        if name == "simhash near-dedup":
            assert Counter(r["doc_id"] for r in docs.collect()).most_common(1)[0][1] == 1 and sizes[-1] < sizes[-2]
        if name == "personal data":
            assert sizes[-1] == sizes[-2] and docs.where("text like '%[EMAIL]%'").count() > 0
            assert docs.where(r"text rlike '[a-z]@[a-z]+[0-9]*[.]example[.]com'").count() == 0
        if name == "source mix":
            assert max(Counter(r["doc_id"] for r in docs.collect()).values()) <= 3
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "personal data", "source mix", "byte-level BPE"]
    assert sorted(docs.select("doc_id", "n_tokens").collect()) == sorted(
        corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect())


def test_every_operator_is_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


def test_encoding_carries_digests_beside_codes_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "naïve café, twice  over", "fr", "s"), (2, None, "en", "s"), (2, "x" * 70, "en", None)],
                                 "doc_id long, text string, lang string, source string")
    coded = corpus_pipeline.encoded(spark, docs, "")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "text#" not in plan
    rows = coded.collect()
    assert len(rows) == 3 and all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in rows)
