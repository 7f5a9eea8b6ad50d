"""Operators one by one, on small frames and on skewed ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared_rows import TAKINGS, takings

from smelter.functions import format_metric, round_metric
from smelter.operators import (answer_questions, build_daily_fact, category_vocabulary, contract_rows, dedupe_all,
                               dedupe_first, dim_values, clean_silver, governance_verdict, lineage_roots, mask_pii,
                               metric_query, panels_for_role, reconcile, reconcile_rows, refresh_panels, rollup_metric,
                               route_questions, version_diff, visible_to)
from smelter.operators.audit import audit_frame
from smelter.operators.learn import (FeatureSchema, LinearModel, build_features, build_schema, evaluate, fit_ridge,
                                     gram_cells, holdout, input_violations, regression_metrics, score, train,
                                     with_row_index)
from smelter.plans import (GoldContract, GuardError, Metric, aggregation_class, auto_questions, conformance,
                           dimension_dictionary, metric_column, propose_metrics, reaggregation_verdict, validate_metric)
from smelter.plans.contract import pick_fact
from smelter.plans.metric import with_authored
from smelter.session import small_frame
from smelter.sources import load_metrics, override_proposed, upsert_stage
from smelter.plans import metrics_frame
from smelter.streaming import compact_fact, current_fact, refresh_fact_from_stream

DAILY = {"daily": "gold.agg_t_daily"}


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows of which more than a third share key, day and dimension."""
    n = F.col("id")
    return spark.range(4000).select(
        n.alias("_row_id"), F.when(n % 5 < 2, F.lit(0)).otherwise(n % 97).alias("key"),
        F.when(n % 5 < 2, F.to_date(F.lit("2024-01-01"))).otherwise(F.date_add(F.lit("2024-01-01"), (n % 80).cast("int")))
        .alias("day"), F.when(n % 5 < 2, "hot").otherwise(F.concat(F.lit("d"), (n % 6).cast("string"))).alias("dim"),
        (n % 13 + 0.25).alias("amount"), (n % 31).alias("user"))


# --- silver ------------------------------------------------------------------

def test_first_row_per_key_wins(spark, skewed):
    kept = dedupe_first(skewed, ["key"], ["_row_id"])
    rows = {r["key"]: r["_row_id"] for r in kept.collect()}
    want = {}
    for r in skewed.orderBy("_row_id").collect():
        want.setdefault(r["key"], r["_row_id"])
    assert rows == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan  # a hot key is cut to one row per task before the shuffle


def test_null_keys_are_one_key(spark):
    df = small_frame(spark, [(0, None, "a"), (1, None, "b"), (2, "x", "c")], "_row_id long, k string, v string")
    assert sorted(r["v"] for r in dedupe_first(df, ["k"], ["_row_id"]).collect()) == ["a", "c"]


def test_exact_duplicates_without_a_key(spark):
    df = small_frame(spark, [(3, "a", 1), (1, "a", 1), (2, "b", None), (5, "b", None)], "_row_id long, k string, v int")
    assert sorted(tuple(r) for r in dedupe_all(df).select("_row_id", "k").collect()) == [(1, "a"), (2, "b")]


def test_keys_that_coercion_merges(spark):
    df = small_frame(spark, [(0, 1, "05/01/2024", "x"), (1, 1, "2024-01-06", "y"), (2, 2, "2024/1/7", " ")],
                     "_row_id long, id long, day string, note string")
    rows = clean_silver(df, {"id": "integer", "day": "date", "note": "text"}, ["id"], ["_row_id"]).orderBy("id").collect()
    assert [(r["id"], str(r["day"]), r["note"]) for r in rows] == [(1, "2024-01-05", "x"), (2, "2024-01-07", None)]


# --- gold --------------------------------------------------------------------

def test_fact_keeps_rows_without_a_day(spark):
    df = small_frame(spark, [("2024-01-01", "a", 1.5), (None, "a", 2.5), (None, None, 4.0)], "d string, k string, v double")
    df = df.withColumn("d", F.col("d").cast("timestamp"))
    fact = build_daily_fact(df, "d", ["k"], ["v"], "t")
    assert fact.columns == ["d_day", "k", "v", "t_count"] and fact.count() == 3
    assert [r["result"] for r in reconcile(df, fact, ["v"], strict=True).collect()] == ["pass"]
    assert reconcile_rows(df, fact, "t_count").first()["result"] == "pass"


def test_reconcile_finds_a_lost_row(spark, skewed):
    fact = build_daily_fact(skewed.where("_row_id <> 17"), "day", ["dim"], ["amount"], "t")
    assert reconcile(skewed, fact, ["amount"]).first()["result"] == "fail"
    assert reconcile_rows(skewed, fact, "t_count").first()["result"] == "fail"
    with pytest.raises(ValueError):
        reconcile(skewed, fact, ["amount"], strict=True)


def test_exact_fact_has_exact_totals(spark):
    df = spark.range(3000).select(F.to_date(F.lit("2024-01-01")).alias("day"), (F.lit(0.1)).alias("v"))
    fact = build_daily_fact(df, "day", [], ["v"], "t", exact=True)
    assert fact.first()["v"] == 300.0
    assert reconcile(df, fact, ["v"], relative=0.0).first()["result"] == "pass"


# --- metrics -----------------------------------------------------------------

def test_guard_verdicts():
    assert reaggregation_verdict("sum")["strategy"] == "sum"
    assert reaggregation_verdict("ratio") ["strategy"] == "recompute" and not reaggregation_verdict("ratio")["ok"]
    assert reaggregation_verdict("avg")["guard"] == "non-additive"
    assert reaggregation_verdict("count_distinct")["strategy"] == "sketch"
    assert reaggregation_verdict("derived")["strategy"] == "recompute-derived"
    assert reaggregation_verdict("ratio", "monthly", "daily")["strategy"] == "exact"
    assert reaggregation_verdict("ratio", "daily", "daily")["ok"]
    assert reaggregation_verdict("ratio", "daily", "century")["ok"] is False
    assert reaggregation_verdict("ratio", "hourly", "daily")["ok"]
    assert [aggregation_class(a) for a in ("min", "avg", "count_distinct", "derived")] == [
        "additive", "ratio-like", "non-additive-distinct", "derived"]


def test_validation():
    assert validate_metric(Metric("m", "sum", measure="v", rollups=DAILY)) == []
    assert validate_metric(Metric("m", "count", rollups=DAILY)) == []
    assert len(validate_metric(Metric("", "median"))) == 3
    assert validate_metric(Metric("m", "avg", rollups=DAILY)) and validate_metric(Metric("m", "derived", rollups=DAILY))
    assert validate_metric(Metric("m", "ratio", numerator="a", rollups=DAILY))
    with pytest.raises(ValueError):
        metric_column(Metric("m", "median"))


def test_proposals_and_names():
    one = GoldContract("agg_a_daily", "fact", "own", "d_day", ["x", "y"], ["v", "w"], "a_count", {"v": "real", "w": "integer"})
    two = GoldContract("agg_b_daily", "fact", grain="e_day", dims=["y"], measures=["v"], count_col="b_count")
    dim = GoldContract("dim_c", "dim", keys=["id"])
    proposed = {m.metric: m for m in propose_metrics([one, two, dim])}
    assert set(proposed) == {"agg_a_daily.v", "w", "a", "agg_b_daily.v", "b"}
    assert (proposed["w"].round, proposed["w"].unit, proposed["agg_a_daily.v"].round) == (0, "count", 2)
    assert dimension_dictionary([one, two, dim]) == ["x", "y"]
    assert pick_fact([two, one, dim]) is one and pick_fact([one, two], "b") is two
    mine = Metric("w", "avg", measure="w", rollups={"daily": "gold.agg_a_daily"})
    merged = with_authored(list(proposed.values()), [mine], [one, two])
    assert [m.metric for m in merged] == sorted(proposed)
    assert next(m for m in merged if m.metric == "w").count_col == "a_count"
    assert auto_questions(merged, ["x"], 1) == ["A overall", "A per x"]


def test_metric_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"metric": "b", "aggregation": "sum", "measure": "v", "rollups": DAILY}))
    (tmp_path / "a.yaml").write_text("metric: a_b\naggregation: derived\ngolden_query: sum(v) / 2\nrollups: {daily: gold.t}\n")
    loaded = load_metrics(spark, str(tmp_path))
    assert [(m.metric, m.label, m.expression) for m in loaded] == [("b", "B", None), ("a_b", "A B", "sum(v) / 2")]
    proposed = metrics_frame(spark, [Metric("b", "sum", measure="old"), Metric("c", "sum", measure="v")])
    rows = override_proposed(proposed, metrics_frame(spark, loaded)).orderBy("metric").collect()
    assert [(r["metric"], r["measure"]) for r in rows] == [("a_b", None), ("b", "v"), ("c", "v")]


def test_conformance_names_what_is_wrong(spark, skewed):
    fact = build_daily_fact(skewed, "day", ["dim"], ["amount"], "t")
    checked = {r["metric"]: r for r in conformance(spark, {"agg_t_daily": fact}, [
        Metric("good", "ratio", numerator="amount", denominator="t_count", rollups=DAILY),
        Metric("missing", "sum", measure="nope", rollups=DAILY), Metric("unbound", "sum", measure="amount"),
        Metric("elsewhere", "count", rollups={"daily": "gold.other"}),
        Metric("typo", "derived", expression="sum(amount", rollups=DAILY)]).collect()}
    assert {m: r["result"] for m, r in checked.items()} == {
        "good": "pass", "missing": "fail", "unbound": "fail", "elsewhere": "fail", "typo": "fail"}
    assert "UNRESOLVED_COLUMN" in checked["missing"]["error"]
    assert checked["good"]["guard_strategy"] == "recompute"


def test_rollups_recompute(spark, skewed, collect):
    fact = build_daily_fact(skewed, "day", ["dim"], ["amount"], "t", distinct_cols=["user"])
    month = F.date_trunc("month", "day").cast("date")
    for metric, truth in (
            (Metric("m", "sum", measure="amount"), F.sum("amount")),
            (Metric("m", "ratio", numerator="amount", denominator="t_count"), F.avg("amount")),
            (Metric("m", "avg", measure="amount", count_col="t_count"), F.avg("amount")),
            (Metric("m", "derived", expression="sum(amount) * 2"), F.sum("amount") * 2)):
        got = {(r["period"], r["dim"]): round(r["m"], 6) for r in collect(rollup_metric(fact, metric, "monthly", "day_day", ["dim"]))}
        want = {(r["p"], r["dim"]): round(r["m"], 6) for r in collect(skewed.groupBy(month.alias("p"), "dim").agg(truth.alias("m")))}
        assert got == want, metric.aggregation
    low = Metric("m", "min", measure="amount")
    by_day = {r["day_day"]: r["m"] for r in collect(metric_query(fact, low, "day_day", limit=None))}
    assert rollup_metric(fact, low, "yearly", "day_day").first()["m"] == min(by_day.values())


@pytest.mark.parametrize("kind", ["hll", "theta"])
def test_distinct_counts_need_a_sketch(spark, skewed, kind):
    users = Metric("users", "count_distinct", measure="user")
    plain = build_daily_fact(skewed, "day", ["dim"], ["amount"], "t")
    with pytest.raises(GuardError):
        rollup_metric(plain, users, "monthly", "day_day")
    with pytest.raises(GuardError):
        rollup_metric(plain, Metric("s", "sum", measure="amount"), "century", "day_day")
    fact = build_daily_fact(skewed, "day", ["dim"], ["amount"], "t", distinct_cols=["user"], sketch=kind)
    estimate = rollup_metric(fact, users, "yearly", "day_day", sketch=kind).first()["users"]
    assert abs(estimate - 31) <= 1
    dims = Metric("dims", "count_distinct", measure="dim")
    assert rollup_metric(plain, dims, "yearly", "day_day").first()["dims"] == 7


def test_ties_are_ranked_by_the_dimension(spark):
    fact = small_frame(spark, [("b", 1), ("a", 1), ("c", 2), (None, None)], "k string, v int")
    m = Metric("m", "sum", measure="v")
    assert [r["k"] for r in metric_query(fact, m, "k").collect()] == ["c", "a", "b", None]
    assert [r["k"] for r in metric_query(fact, m, "k", order="asc", limit=2).collect()] == [None, "a"]
    assert metric_query(fact, m, filters=[("k", "c"), ("v", 2)]).first()["m"] == 2


def test_display(spark):
    df = small_frame(spark, [(0, 1234567.8), (1, 12.5), (2, 7.0), (3, None), (4, -999.994)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(format_metric("v")).collect()] == ["1,234,568", "12.5", "7", None, "-999.99"]
    assert df.select(round_metric(F.col("v"), 0)).first()[0] == 1234568.0


# --- questions ---------------------------------------------------------------

def test_routing_words(spark):
    metrics = [Metric("gmv", "sum", measure="v", label="Gross Value"), Metric("gmv_net", "sum", measure="w", label="Net")]
    values = {"promo": ["0", "1"], "city": ["New York", "York"], "tier": ["Metro"]}
    asked = ["top 10 gmv by city", "GMV_NET per tier for metro", "gross value in new york", "gmv for metropolis", "bottom 3 net across city",
             "gmv promo 1 city", "nothing here"]
    df = small_frame(spark, list(enumerate(asked)), "i int, question string")
    got = [r.asDict(recursive=True) for r in route_questions(df, metrics, ["city", "tier"], values).orderBy("i").collect()]
    assert [g["metric"] for g in got] == ["gmv", "gmv_net", "gmv", "gmv", "gmv_net", "gmv", None]
    assert [g["breakdown"] for g in got] == ["city", "tier", None, None, "city", None, None]
    assert [[(f["dim"], f["value"]) for f in g["filters"]] for g in got] == [
        [], [("tier", "Metro")], [("city", "New York")], [], [], [("promo", "1")], []]
    assert [(g["order"], g["limit"]) for g in got[:5]] == [("desc", 10), ("desc", 10), ("desc", None), ("desc", None), ("asc", 3)]
    loose = route_questions(df, metrics, ["city"], values, whole_words=False).orderBy("i").collect()
    assert [(f["dim"], f["value"]) for f in loose[3]["filters"]] == [("tier", "Metro")]
    assert [(f["dim"], f["value"]) for f in loose[0]["filters"]] == [("promo", "0")]


def test_very_many_values_stay_off_the_driver(spark):
    """Neither the value table nor what was found of it is broadcast; few values are, and the rows are those of either way."""
    names = spark.range(25_000).select(F.lit("who").alias("dim"), F.format_string("Name#%09d", "id").alias("value"))
    asked = names.select(F.concat(F.lit("gmv for "), "value", F.lit(" please")).alias("question"), "value")
    routed = route_questions(asked, [Metric("gmv", "sum", measure="v")], ["who"], names)
    assert routed.where("answered and size(filters) = 1 and filters[0].value = value").count() == 25_000
    routed.collect()
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    few = route_questions(asked.limit(50), [Metric("gmv", "sum", measure="v")], ["who"], names.limit(50))
    few.collect()
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_value_dictionary_is_whole_and_sorted(spark):
    fact = spark.range(300).select(F.format_string("v%03d", F.col("id")).alias("a"), (F.col("id") % 2 == 0).alias("b"))
    other = small_frame(spark, [("zz",), (None,)], "a string")
    values = {r["dim"]: r["values"] for r in dim_values([(fact, ["a", "b"]), (other, ["a"])]).collect()}
    assert values == {"a": [f"v{i:03d}" for i in range(300)] + ["zz"], "b": ["false", "true"]}


def test_a_value_is_found_among_many_or_the_question_stays_open(spark):
    fact = spark.range(300).select(F.format_string("city%d", F.col("id")).alias("city"), F.col("id").alias("v"))
    sales = [Metric("v", "sum", measure="v", label="Sales", rollups={"daily": "gold.t"})]
    asked = ["total sales for city250", "total sales for city999", "top 12345678901 sales by city", "sales for each city", "sales"]
    answers, notes = answer_questions(spark, {"t": (fact, ["city"])}, sales, asked)
    assert answers[1].first()["v"] == 250 and 2 not in answers
    rows = {r["question_no"]: r for r in notes.collect()}
    assert rows[1]["answered"] and not rows[2]["answered"] and "city999" in rows[2]["note"]
    assert rows[3]["limit"] == 10 and rows[4]["breakdown"] == "city" and rows[5]["answered"]


def test_a_breakdown_stays_in_the_metrics_fact(spark):
    t = small_frame(spark, [("x", 1), ("y", 2)], "k string, v int")
    u = small_frame(spark, [("q", 5)], "region string, w int")
    metrics = [Metric("v", "sum", measure="v", rollups={"daily": "gold.t"}), Metric("w", "sum", measure="w", rollups={"daily": "gold.u"})]
    answers, notes = answer_questions(spark, {"t": (t, ["k"]), "u": (u, ["region"])}, metrics, ["v by region", "w by region"])
    assert answers[1].collect()[0].asDict() == {"v": 3}
    assert answers[2].collect()[0].asDict() == {"region": "q", "w": 5}


# --- panels, audit, versions --------------------------------------------------

def test_visibility_rules(spark):
    panels = small_frame(spark, [("kpi", None, "finance-cdm"), ("kpi", None, None), ("breakdown", "city", "x")],
                         "kind string, dim string, owner string")
    seen = [r["visible_to"] for r in visible_to(panels).collect()]
    assert seen == [["admin", "analyst", "leadership"], ["admin", "analyst", "leadership", "viewer"], ["admin", "analyst"]]
    assert panels_for_role(visible_to(panels), "viewer").count() == 1


def test_refresh_overwrites(spark, skewed, tmp_path):
    metric = Metric("total", "sum", measure="amount", rollups=DAILY)
    path = str(tmp_path / "panels")
    for rows in (skewed.where("_row_id < 100"), skewed):
        fact = build_daily_fact(rows, "day", ["dim"], ["amount"], "t")
        shown = refresh_panels(spark, {"agg_t_daily": (fact, ["dim"])}, [metric], path, "hourly")
    kpi = shown.where("kind = 'kpi'").first()
    assert kpi["value"] == skewed.agg(F.sum("amount")).first()[0] and kpi["cadence"] == "hourly"
    assert shown.count() == 8


def test_masking(spark):
    df = small_frame(spark, [("a", "b", "c")], "x string, y string, z string")
    out = mask_pii(df, {"x": "masked", "y": "dropped", "z": "flagged"}).first().asDict()
    assert set(out) == {"x", "z"} and len(out["x"]) == 64 and out["z"] == "c"
    with pytest.raises(ValueError):
        mask_pii(df, {"x": "erased"})


def test_a_failed_check_breaks_the_contract(spark):
    quality = audit_frame(spark, "quality", [("bronze", 0, "a", "warn", ""), ("gold", 2, "b", "fail", ""), ("gold", 2, "c", "pass", "")])
    contracts = contract_rows(quality, "r")
    assert {r["stage"]: (r["honored"], r["violations"]) for r in contracts.collect()} == {"bronze": (True, []), "gold": (False, ["b"])}
    verdict = governance_verdict(contracts, quality).first()
    assert not verdict["governed"]
    assert verdict["issues"] == ["contract r.gold@1 violated: b", "1 quality check(s) failed"]
    empty = governance_verdict(audit_frame(spark, "contract"), audit_frame(spark, "quality")).first()
    assert empty["governed"] is True


def test_roots_and_stage_replacement(spark, tmp_path):
    first = audit_frame(spark, "lineage", [("a", 0, "x", ["f", "g"], ""), ("b", 1, "y", ["x"], "")])
    assert {r["root"] for r in lineage_roots(first).collect()} == {"f", "g"}
    path = str(tmp_path / "lineage")
    upsert_stage(first, path)
    upsert_stage(audit_frame(spark, "lineage", [("b", 1, "z", ["x"], "")]), path)
    assert {(r["stage"], r["output"]) for r in spark.read.parquet(path).collect()} == {("a", "x"), ("b", "z")}


def test_versions_grow_with_content(spark, collect):
    def store(rows):
        return small_frame(spark, rows, "id string, v int, w string")
    first = version_diff(None, store([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")]), "id")
    second = version_diff(first, store([("a", 1, None), ("b", 5, "x"), ("d", 4, "z")]), "id")
    third = version_diff(second, store([("a", 1, "n"), ("b", 6, "x"), ("c", 3, "y"), ("d", 4, "z")]), "id")
    states = [{r["id"]: (r["status"], r["version"], len(r["changelog"])) for r in collect(s)} for s in (first, second, third)]
    assert states[0] == {k: ("created", 1, 1) for k in "abc"}
    assert states[1] == {"a": ("unchanged", 1, 1), "b": ("changed", 2, 2), "c": ("removed", 1, 1), "d": ("created", 1, 1)}
    assert states[2] == {"a": ("changed", 2, 2), "b": ("changed", 3, 3), "c": ("created", 1, 1), "d": ("unchanged", 1, 1)}


# --- learning ----------------------------------------------------------------

def test_row_index_is_global_and_ordered(spark, skewed):
    indexed, total = with_row_index(skewed.drop("_row_id").withColumn("u", F.monotonically_increasing_id()), ["dim", "day", "u"])
    rows = indexed.orderBy("_index").collect()
    assert total == 4000 and [r["_index"] for r in rows] == list(range(4000))
    assert [(r["dim"], r["day"], r["u"]) for r in rows] == sorted((r["dim"], r["day"], r["u"]) for r in rows)


def test_holdout_of_a_single_row_uses_it_twice(spark):
    one = small_frame(spark, [(1, 2.0)], "k int, v double")
    assert holdout(one, ["k"]).first().asDict() == {"k": 1, "v": 2.0, "is_train": True, "is_test": True}


def brute_force(rows, schema, lam):
    x = []
    for r in rows:
        x.append([1.0] + [float(r[n] or 0) for n in schema.numeric]
                 + [1.0 if str(r[c]) == v else 0.0 for c, vs in schema.categorical.items() for v in vs])
    x, y = np.array(x), np.array([float(r[schema.target] or 0) for r in rows])
    penalty = np.eye(x.shape[1]) * lam
    penalty[0, 0] = 0
    return np.linalg.solve(x.T @ x + penalty, x.T @ y), x, y


@pytest.mark.parametrize("categories", [4, 40])
def test_ridge_equals_the_closed_form(spark, categories):
    n = F.col("id")
    df = spark.range(600).select(n.alias("i"), (n % 17).alias("a"), F.when(n % 11 != 0, n % 5 * 0.5).alias("b"),
                                 F.concat(F.lit("c"), (n % categories).cast("string")).alias("c"), (n % 2 == 0).alias("f"),
                                 (n % 17 * 3.0 - n % 5 + n % categories * 2 + (n * 7919) % 101 / 10).alias("y"))
    schema = build_schema(df, ["a", "b"], ["c", "f"], "y")
    assert schema.feature_names[:4] == ["_bias", "a", "b", "c=c1"] and schema.feature_names[-1] == "f=true"
    model = fit_ridge(df, schema, lam=0.7)
    rows = [{**r.asDict(), "f": str(r["f"]).lower()} for r in df.collect()]
    weights, x, y = brute_force(rows, schema, 0.7)
    assert np.allclose(model.weights, weights, atol=1e-8)
    predicted = [r["prediction"] for r in score(df, model).orderBy("i").collect()]
    assert np.allclose(predicted, x @ weights)
    assert np.allclose([list(r)[1:] for r in build_features(df, schema, ["i"]).orderBy("i").collect()], x)
    cells = {(r["i"], r["j"]): r["value"] for r in gram_cells(df, schema).collect()}
    full = np.column_stack([x, y])
    gram = full.T @ full
    for i in range(len(gram)):
        for j in range(i, len(gram)):
            assert abs(cells.get((i, j), 0.0) - gram[i, j]) < 1e-6
    again = LinearModel.from_json(model.to_json())
    assert again == model and again.hash == model.hash


def test_unseen_and_missing_inputs(spark):
    schema = FeatureSchema("y", ["n"], {"c": ["b"]}, {"c": "a"})
    model = LinearModel(schema, [1.0, 2.0, 10.0], 1.0)
    df = small_frame(spark, [(0, "3", "b"), (1, None, "zzz"), (2, "x", "a"), (3, "1", None)], "i int, n string, c string")
    assert [r["prediction"] for r in score(df, model).orderBy("i").collect()] == [17.0, 1.0, 1.0, 3.0]
    bad = input_violations(df, schema, ["i"]).orderBy("i", "feature").collect()
    assert [(r["i"], r["feature"], r["problem"]) for r in bad] == [
        (1, "c", "unknown category"), (1, "n", "missing number"), (2, "n", "missing number"), (3, "c", "unknown category")]
    assert schema.input_spec() == {"numeric": ["n"], "categorical": {"c": ["a", "b"]}}


def test_single_category_stays_a_feature(spark):
    df = small_frame(spark, [("only", 1.0), ("only", 3.0), (None, 2.0)], "c string, y double")
    assert build_schema(df, [], ["c"], "y").feature_names == ["_bias", "c=only"]
    assert [r["is_baseline"] for r in category_vocabulary(df, ["c"]).collect()] == [False]


def test_metrics_without_variance(spark):
    df = small_frame(spark, [("p", 2.0, 2.0), ("p", 2.0, 2.0), ("q", 2.0, 3.0)], "g string, y double, prediction double")
    got = {r["g"]: (r["n"], r["r2"], r["rmse"], r["mae"]) for r in regression_metrics(df, "y", by=["g"]).collect()}
    assert got == {"p": (2, 1.0, 0.0, 0.0), "q": (1, 0.0, 1.0, 1.0)}
    none = regression_metrics(df.where("g = 'x'"), "y").first()
    assert none.asDict() == {"n": 0, "r2": None, "rmse": None, "mae": None}


def test_model_recovers_the_truth(kiosk):
    contract = pick_fact(kiosk.contracts)
    assert (contract.grain, contract.dims, contract.measures) == ("day_day", ["counter"], ["guests", "rain", "takings"])
    fact = kiosk.table("gold", contract.table)
    model, metrics = train(fact, contract, "takings", lam=1e-6)
    by_split = {r["split"]: r for r in metrics.collect()}
    assert (by_split["train"]["n"], by_split["test"]["n"]) == (48, 12)
    assert by_split["test"]["r2"] > 0.999
    learned = model.coefficients()
    assert learned["guests"] == pytest.approx(TAKINGS["guests"], abs=0.01) and learned["rain"] == pytest.approx(TAKINGS["rain"], abs=0.1)
    case = small_frame(kiosk.spark, [("right", 77, 1)], "counter string, guests int, rain int")
    assert score(case, model).first()["prediction"] == pytest.approx(takings("right", 77, 1), abs=0.5)
    assert model.schema.input_spec()["categorical"] == {"counter": ["left", "middle", "right"]}
    assert train(fact, contract)[0].schema.target == "takings"


def test_gram_rows_do_not_depend_on_the_number_of_features(spark, monkeypatch):
    from smelter.operators import learn as module
    df = spark.range(30).select(F.col("id").cast("double").alias("y"), (F.col("id") % 3).cast("string").alias("c"))
    schema = FeatureSchema("y", [], {"c": ["1", "2"]}, {"c": "0"})
    dense = {(r["i"], r["j"]): r["value"] for r in gram_cells(df, schema).collect()}
    monkeypatch.setattr(module, "_DENSE_LIMIT", 0)
    assert dense == {(r["i"], r["j"]): r["value"] for r in gram_cells(df, schema).collect()}


def test_sums_keep_their_digits_at_any_size(spark):
    from smelter.operators.gold import decimal_scales
    df = spark.range(100000).select(F.lit("2024-01-01").alias("day"), F.lit(4e-7).alias("small"), F.lit(1e33).alias("vast"),
                                    F.when(F.col("id") == 5, float("nan")).otherwise(1.0).alias("broken"))
    assert set(decimal_scales(df, ["small", "vast", "broken"])) == {"small"}
    fact = build_daily_fact(df, "day", [], ["small", "vast"], "t", exact=True)
    row = fact.first()
    assert row["small"] == 0.04 and row["vast"] == pytest.approx(1e38)
    assert {r["measure"]: r["result"] for r in reconcile(df, fact, ["small", "vast"]).collect()} == {"small": "pass", "vast": "pass"}
    short = build_daily_fact(df.where("id > 0"), "day", [], ["small"], "t", exact=True)
    assert reconcile(df, short, ["small"]).first()["result"] == "fail"


def test_versions_of_null_and_repeated_keys(spark):
    old = small_frame(spark, [(None, "a"), ("k", "b")], "id string, v string")
    new = small_frame(spark, [(None, "a"), ("k", "c")], "id string, v string")
    assert {r["id"]: r["status"] for r in version_diff(old, new, "id").collect()} == {None: "unchanged", "k": "changed"}
    with pytest.raises(ValueError):
        version_diff(old, new.unionByName(new), "id")


# --- streaming ---------------------------------------------------------------

@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_drained_stream_equals_batch(spark, skewed, tmp_path, zone):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    rows = skewed.withColumn("day", F.when(F.col("_row_id") % 11 != 0, F.col("day").cast("timestamp")))
    # Every arrival has rows of days that others had before: late rows count.
    parts = [rows.where("_row_id % 97 < 40"), rows.where("_row_id % 97 >= 40 and _row_id % 2 = 0 and day is not null"),
             rows.where("_row_id % 97 >= 40 and (_row_id % 2 = 1 or day is null)")]

    def refresh():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        refresh_fact_from_stream(stream, "day", ["dim"], ["amount"], "t", log, str(tmp_path / "checkpoint")).awaitTermination()

    for number, part in enumerate(parts):  # three refreshes, each picking up where the last one stopped
        part.coalesce(1).write.mode("append").parquet(src)
        refresh()
        if number == 1:
            assert compact_fact(spark, log, "day_day", ["dim"]) == 1
    got = {tuple(r) for r in current_fact(spark, log, "day_day", ["dim"]).collect()}
    want = {tuple(r) for r in build_daily_fact(rows, "day", ["dim"], ["amount"], "t").collect()}
    assert got == want and any(r[0] is None for r in got)
    assert compact_fact(spark, log, "day_day", ["dim"]) == 2
    assert {tuple(r) for r in current_fact(spark, log, "day_day", ["dim"]).collect()} == want


def test_evaluation_covers_both_sides(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("y"), (F.col("id") * 2).alias("a"))
    split = holdout(df, ["k"])
    model = fit_ridge(split.where("is_train"), FeatureSchema("y", ["a"], {}, {}), lam=0.0)
    got = {r["split"]: (r["n"], r["r2"]) for r in evaluate(split, model).collect()}
    assert got == {"train": (40, 1.0), "test": (10, 1.0)}


def test_hundredths_add_up_as_longs_to_the_sum_that_decimals_have(spark):
    from smelter.operators.gold import _decimal_sum, decimal_scales, exact_sums
    money = [0.01, -0.01, 0.29, 1.1, -0.0, None, 9_999_999_999_999.99, -9_999_999_999_999.98, 0.07, 123456.78, -5e-324 * 0]
    mixed = [0.1 + 0.2, 1 / 3, 2.0, None, 1e-9, 5.25, -7.125, 0.0, 1e12, 3.0, 4.0]
    large = [1e15, 0.5, 0.25, None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame(list(zip(money, mixed, large, [None] * 11)), "money double, mixed double, large double, none double")
    names = df.columns
    sums = exact_sums(df, names)
    expected = df.agg(*[_decimal_sum(m, decimal_scales(df, names)[m]).cast("double").alias(m) for m in names]).first()
    assert df.agg(*[sums[m].alias(m) for m in names]).first() == expected
    plans = {m: df.agg(sums[m])._jdf.queryExecution().optimizedPlan().toString() for m in names}
    assert [m for m in names if "decimal(38," not in plans[m].split("Project")[-1].split("Aggregate")[-1] and "shiftright" in plans[m]] == ["money", "none"]
    broken = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert exact_sums(broken, ["v"]) == {}
