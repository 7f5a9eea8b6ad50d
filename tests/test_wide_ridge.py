"""Ridge regression with any number of categories: against the closed form, and its corner cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from smelter.operators import build_schema, fit_ridge, score
from smelter.operators import learn as learning
from smelter.operators.learn import evaluate, train
from smelter.operators.wide_ridge import WideModel, fit_wide_ridge, normal_cells, score_wide
from smelter.plans.contract import GoldContract
from smelter.session import small_frame


def sample(spark, rows=600, categories=40):
    n = F.col("id")
    return spark.range(rows).select(
        n.alias("i"), (n % 17).alias("a"), F.when(n % 11 != 0, n % 5 * 0.5).alias("b"),
        F.when(n % 13 != 0, F.concat(F.lit("c"), (n % categories).cast("string"))).alias("c"), (n % 2 == 0).alias("f"),
        (n % 17 * 3.0 - n % 5 + n % categories * 2 + (n * 7919) % 101 / 10).alias("y"))


@pytest.mark.parametrize("categories,lam", [(4, 1.0), (40, 0.7), (40, 0.0)])
def test_equals_the_closed_form(spark, categories, lam):
    df = sample(spark, categories=categories)
    narrow = fit_ridge(df, build_schema(df, ["a", "b"], ["c", "f"], "y"), lam)
    wide = fit_wide_ridge(df, ["a", "b"], ["c", "f"], "y", lam)
    want, got = narrow.coefficients(), {r["feature"]: r["weight"] for r in wide.coefficients().collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    rows = score(df, narrow).select("i", F.col("prediction").alias("p")).join(score_wide(df, wide), "i").collect()
    assert len(rows) == 600 and all(abs(r["p"] - r["prediction"]) < 1e-6 for r in rows)


def test_ten_thousand_categories(spark):
    """One column's weights can be eliminated, which leaves the bias. A third of the rows hold one category."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).otherwise(n % 10_007)
    df = spark.range(90_000).select(key.cast("string").alias("key"), (key % 91 + n % 7 * 0.25).alias("y"))
    got = {r["feature"]: r["weight"] for r in fit_wide_ridge(df, [], ["key"], "y", tolerance=1e-13).coefficients().collect()}
    groups = {r["key"]: (r["n"], r["y"]) for r in df.groupBy("key").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    low = min(groups)
    rest = [v for k, v in groups.items() if k != low]
    left = sum(n for n, _ in groups.values()) - sum(n * n / (n + 1) for n, _ in rest)
    right = sum(y for _, y in groups.values()) - sum(n * y / (n + 1) for n, y in rest)
    bias = right / left
    assert len(got) == len(groups) > 10_000 and f"key={low}" not in got
    assert abs(got["_bias"] - bias) < 1e-8
    for k, (n, y) in groups.items():
        assert k == low or abs(got[f"key={k}"] - (y - bias * n) / (n + 1)) < 1e-8


def test_steps_join_by_key_and_broadcast_the_few(spark):
    df = sample(spark)
    cells = normal_cells(df, ["a"], ["c"], {"c": "c0"}, "y")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "NestedLoop" not in plan


def test_unseen_missing_and_clashing(spark):
    df = small_frame(spark, [("p", 1.0, 1.0), ("q", 2.0, 5.0), ("q", None, 4.0), (None, 3.0, 2.0), ("r", 1.0, None)],
                     "`c.x` string, n double, y double")
    model = fit_wide_ridge(df, ["n"], ["c.x"], "y", 0.5)
    want = fit_ridge(df, build_schema(df, ["n"], ["c.x"], "y"), 0.5).coefficients()
    got = {r["feature"]: r["weight"] for r in model.coefficients().collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    new = small_frame(spark, [("never", None, 1, "k", 9.0), ("q", 1.0, 2, "k", 9.0), ("q", 1.0, 2, "k", 9.0), (None, 1.0, 3, None, 9.0)],
                      "`c.x` string, n double, _wsum int, _wkey string, prediction double")
    scored = score_wide(new, model)
    assert scored.columns == ["c.x", "n", "_wsum", "_wkey", "prediction"]
    got_rows = sorted((r["_wsum"], r["prediction"]) for r in scored.collect())
    bias, slope = want["_bias"], want["n"]
    for (_, p), q in zip(got_rows, [bias, bias + slope + want["c.x=q"], bias + slope + want["c.x=q"], bias + slope]):
        assert abs(p - q) < 1e-8


def test_empty_tables_single_categories_and_zero_columns(spark):
    df = small_frame(spark, [("only", 1.0, 0.0), ("only", 3.0, 0.0), (None, 2.0, 0.0)], "c string, y double, zero double")
    got = {r["feature"]: r["weight"] for r in fit_wide_ridge(df, ["zero"], ["c"], "y").coefficients().collect()}
    assert got.keys() == {"_bias", "zero", "c=only"} and got["zero"] == 0.0
    assert {r["feature"]: r["weight"] for r in fit_wide_ridge(df, ["zero"], [], "y", 0.0).coefficients().collect()} \
        == {"_bias": 2.0, "zero": 0.0}
    none = fit_wide_ridge(df.limit(0), ["zero"], ["c"], "y")
    assert [tuple(r) for r in none.coefficients().collect()] == [("_bias", 0.0)]
    assert [r["prediction"] for r in score_wide(df, none).collect()] == [0.0, 0.0, 0.0]
    assert score_wide(df.limit(0), none).count() == 0


def test_what_is_not_solved_is_not_returned(spark):
    with pytest.raises(ValueError, match="not solved after 1 steps"):
        fit_wide_ridge(sample(spark), ["a", "b"], ["c", "f"], "y", max_rounds=1)


def test_training_goes_wide_beyond_the_driver(spark, monkeypatch, tmp_path):
    fact = sample(spark).select(F.date_add(F.lit("2024-01-01"), F.col("i").cast("int")).alias("day"), "c", "f",
                                F.col("a").cast("double").alias("a"), "y")
    contract = GoldContract("t", "fact", grain="day", dims=["c", "f"], measures=["a", "y"])
    narrow, expected = train(fact, contract, "y")
    monkeypatch.setattr(learning, "MAX_FEATURES", 8)
    wide, metrics = train(fact, contract, "y")
    assert isinstance(wide, WideModel) and wide.target == narrow.target == "y" and wide.trained_on == "gold.t"
    assert sorted(map(tuple, metrics.collect())) == sorted(map(tuple, expected.collect()))
    wide.weights.write.parquet(str(tmp_path / "weights"))
    again = WideModel.from_json(wide.to_json(), spark.read.parquet(str(tmp_path / "weights")))
    assert again.hash == wide.hash and again.baseline == wide.baseline
    assert sorted(map(tuple, evaluate(fact.withColumns({"is_train": F.lit(True), "is_test": F.lit(False)}), again).collect())) \
        == sorted(map(tuple, evaluate(fact.withColumns({"is_train": F.lit(True), "is_test": F.lit(False)}), wide).collect()))


def test_a_run_stores_and_reads_a_wide_model(kiosk, monkeypatch):
    monkeypatch.setattr(learning, "MAX_FEATURES", 2)
    model, _ = kiosk.learn("takings")
    again = kiosk.model("takings")
    assert isinstance(model, WideModel) and isinstance(again, WideModel) and again.hash == model.hash
    monkeypatch.undo()
    narrow, _ = kiosk.learn("takings")
    assert kiosk.model("takings") == narrow
    got = {r["feature"]: r["weight"] for r in model.coefficients().collect()}
    assert got == pytest.approx(narrow.coefficients(), abs=1e-4)
