import hashlib
import re

import pytest
from pyspark.sql import functions as F

from smelter.llm import boosting, pii
from smelter.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub(r"[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return sorted(found)


def listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES["op3_personal_data"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[2] == k for s in base) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(filter(None, r["spans"].split(",")))


ODD = ["", "a@b.c_d@e.f x@y.zz.", "a@b.cd@e.f", "..@a.b %+-@x.y- a@b a@.c a@b..c", "é a@b.co 🙂 c@d.org", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 0001.02.3.000255",
       "4111 1111 1111 1111 4111-1111-1111-1111, 4111  1111 1111 1111 41111111111111112", "0" * 12 + " " + "0" * 19 + " x " + "0" * 20,
       "+1 (578) 555-6437 4918187128635271 +12 345.678-9 (1) +1234567 +1-2", "1 23 456 7890 123456 7 8", "12345678901 2-3",
       "+" * 50 + "1 2 3 4 5 6 7 8 9", "a" * 5000, "9" * 3000, "1." * 2000 + "1", "x@" * 1000, "mail a@b.co 10.0.0.1 " * 700]


def test_odd_texts(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "a@b.co"), (3, ODD[3])]).withColumns(
        {"base": F.lit("x"), "added": F.lit("y"), "spans": F.lit("z"), "hit": F.lit(1)})
    rows = pii.find_personal_data(docs, pii.PiiModel(boosting.Ensemble(), {})).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "a@b.co" if r["doc_id"] is None else "" if r["doc_id"] == 100 else ODD[r["doc_id"]]
        assert r["spans"] == listed(plain_spans(text)), text[:80]
    assert pii.find_personal_data(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_a_very_long_text_takes_linear_time(make_docs):
    docs = make_docs([(1, "y@z.co 1 " * 40000), (2, "1 2-" * 300000), (3, "a.b" * 400000)])
    counts = {r["doc_id"]: r["n"] for r in pii.find_personal_data(docs, pii.PiiModel(boosting.Ensemble(), {})).select(
        "doc_id", F.size("base").alias("n")).collect()}
    assert counts == {1: 40000, 2: 0, 3: 0}


def test_trees_learn_and_thresholds_need_evidence(spark):
    rows = [([i % 7, i % 5, i % 3], int(i % 7 > 3 and i % 5 != 2)) for i in range(700)]
    df = spark.createDataFrame(rows, "features array<int>, label int").cache()
    model = boosting.fit(df, rounds=12)
    wrong = df.where((model.probability(F.col("features")) >= 0.5) != (F.col("label") == 1)).count()
    assert wrong < 15 and len(model.trees) == 12
    assert boosting.fit(df.where("label = 0")).trees == [] and boosting.fit(df.limit(0)).trees == []
    assert pii._threshold({990: (50, 50), 600: (50, 49), 100: (500, 3)}) == pytest.approx(0.6)
    assert pii._threshold({990: (5, 5)}) is None and pii._threshold({}) is None


def test_redaction_and_what_the_model_adds(spark, make_docs):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    merged = "call +1 (578) 555-6437 4918187128635271 now"
    docs = make_docs([(1, merged, "en", "s", 5), (2, "nothing here 12.5 and 2024", "en", "s", 26), (3, None), (4, "", None, None, 0),
                      (5, "a@b.co and 10.0.0.1 and 999.1.1.1", None, None, 1)]).withColumn("__text", F.lit("k"))
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, model).collect()}
    assert found[1] == "phone:5:22,card:23:39" and found[2] == "" and found[5] == "email:0:6,ip:11:19"
    out = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    assert out[1]["text"] == "call [PHONE] [CARD] now" and out[1]["n_chars"] == 23
    assert out[2]["text"] == "nothing here 12.5 and 2024" and out[2]["n_chars"] == 26
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == "[EMAIL] and [IP] and 999.1.1.1"
    assert pii.redact(docs, model).columns == docs.columns


MISSED = ["call +1 (578) 555-6437 4918187128635271 now", "phone (030) 123-4567, please", "write to bob.k(at)example(dot)org or", "no 4918187128635272 x",
          "total 1234567890 units", "card 4918187128635271"]


def test_what_base_rules_miss_is_no_negative(spark, make_docs):
    """Luhn digits, written-out addresses and cued numbers are found where base rules are not, however small the sample."""
    docs = make_docs([(i, t) for i, t in enumerate(MISSED)])
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, pii.train(docs)).collect()}
    assert found == {0: "phone:5:22,card:23:39", 1: "phone:6:20", 2: "email:9:33", 3: "", 4: "", 5: "card:5:21"}
    plain = F.col("text")
    rows = docs.select("doc_id", pii.base_spans(plain).alias("b"), F.explode(pii.proposals(plain)).alias("s")).select(
        "doc_id", F.col("s.kind").alias("kind"), pii.label(F.col("s"), F.col("b")).alias("label")).collect()
    labels = {(r["doc_id"], pii.KINDS[r["kind"]]): r["label"] for r in rows}
    assert labels[0, "card"] == labels[1, "phone"] == labels[2, "email"] == labels[5, "card"] == 1
    assert labels[3, "card"] == labels[4, "phone"] == 0


def test_no_span_is_added_without_a_threshold(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(MISSED)])
    for model in (pii.PiiModel(boosting.Ensemble(9.0), {}), pii.PiiModel(boosting.Ensemble(-9.0), dict.fromkeys(pii.KINDS, 0.5))):
        assert {r["n"] for r in pii.find_personal_data(docs, model).select(F.size("added").alias("n")).collect()} == {0}


def test_the_prior_lines_hold_what_they_say(spark):
    lines = pii.prior_lines()
    df = spark.createDataFrame([(i, *line) for i, line in enumerate(lines)], "i int, text string, kind string, label int, calibrates boolean")
    found = df.select("i", "kind", F.explode(pii.proposals(F.col("text"))).alias("s")).collect()
    of_kind = {r["i"] for r in found if pii.KINDS[r["s"]["kind"]] == r["kind"]}
    assert len(of_kind) > 0.95 * len(lines) and {lines[i][1:3] for i in of_kind} == {(k, n) for k in pii.KINDS for n in (0, 1)}


def test_precision_and_recall_on_planted_spans(spark):
    """Lines that base rules cannot find are put into documents, and decoys; trees and thresholds come from all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text is not null")
    model = pii.train(docs)
    assert set(model.thresholds) == set(pii.KINDS)
    planted, rows = {}, []
    for r in docs.where("doc_id % 50 = 0").collect():
        n = r["doc_id"] // 50
        a, b, c = 200 + n * 71 % 700, 210 + n * 43 % 700, 1000 + n * 6271 % 9000
        card = pii._with_check_digit(f"5{a}{b}{c}{b}{n % 10}7"[:15])
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        line, kind = [(f"phone ({a}) {b}-{c} please", "phone"), (f"write to k{n}.m(at)place(dot)org today", "email"),
                      (f"call +1 {a} {b} {c} {card} now", "card"), (f"item {wrong} here", None), (f"sum {a}{b}{c} coins", None)][n % 5]
        rows.append((r["doc_id"], r["text"] + "\n" + line))
        planted[r["doc_id"]] = (kind, len(r["text"]) + 1)
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model).select("doc_id", "added").collect()
    hits = wrong_ones = 0
    for r in found:
        kind, start = planted[r["doc_id"]]
        added = {pii.KINDS[s["kind"]] for s in r["added"] if s["start"] >= start}
        hits += kind in added
        wrong_ones += len(added - {kind} - ({"phone"} if kind == "card" else set()))  # a phone number stands before the card
    wanted = sum(k is not None for k, _ in planted.values())
    assert hits >= 0.95 * wanted and wrong_ones <= 0.05 * hits


def test_every_document_teaches(spark, make_docs, monkeypatch):
    """Trees and thresholds are fitted to the proposals of all documents, of however many; equal ones count as often as they stand."""
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("write to a.b@c.org").alias("text"))
    seen, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows: (seen.append(rows.agg(F.sum("n")).first()[0]), fit(rows))[1])
    pii.train(docs)
    prior = pii._prior(spark).where("not calibrates").count()
    held = docs.where(F.pmod(F.shiftright(F.xxhash64("doc_id", "text", F.lit("pii")), 32), F.lit(pii.CALIBRATION_EVERY)) == 0).count()
    assert seen == [n - held + prior] and 0 < held < n / 3


def test_a_weight_stands_for_equal_rows(spark):
    rows = [([i % 7, i % 5, i % 3], int(i % 7 > 3 and i % 5 != 2)) for i in range(700)]
    df = spark.createDataFrame(rows, "features array<int>, label int").cache()
    one, other = boosting.fit(df), boosting.fit(df.groupBy("features", "label").agg(F.count(F.lit(1)).alias("n")).cache())
    p = F.col("features")
    assert df.where(F.abs(one.probability(p) - other.probability(p)) > 1e-9).count() == 0
