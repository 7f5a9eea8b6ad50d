"""The whole way from raw files to audited panels, on the rides of a small bicycle rental."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from shared_rows import MECHANICS, RIDE_COLUMNS, RIDES

from smelter.operators import answer_questions, metric_query, panels_for_role, rollup_metric

ROWS = [dict(zip(RIDE_COLUMNS, r)) for r in RIDES]
FEES = round(sum(r["fee"] for r in ROWS), 2)


def total_by(column, value="fee", rows=ROWS):
    out = defaultdict(float)
    for r in rows:
        out[r[column]] += r[value]
    return {k: pytest.approx(v) for k, v in out.items()}


def by_column(run, table):
    return {r["column"]: r for r in run.spark.read.parquet(f"{run.base}/catalog/{table}").collect()}


def test_two_tables_landed(rental):
    assert [c["table"] for c in rental.catalog] == ["mechanics", "rides"]
    assert rental.table("bronze", "rides").count() == len(RIDES)
    assert rental.table("bronze", "mechanics").count() == len(MECHANICS)
    assert rental.status == "ok"


def test_bronze_is_typed_and_blank_is_null(rental):
    rides = rental.table("bronze", "rides")
    assert round(rides.agg(F.sum("fee")).first()[0], 2) == FEES
    assert rides.where(F.col("rider_mail").isNull()).count() == sum(not r["rider_mail"] for r in ROWS)
    types = {c: r["type"] for c, r in by_column(rental, "rides").items()}
    assert types == {"ride_no": "integer", "ride_day": "date", "rider_mail": "text", "station": "text",
                     "bike": "text", "fee": "real", "km": "integer", "subscribed": "boolean"}


def test_keys_dimensions_samples_in_catalog(rental):
    rides = by_column(rental, "rides")
    assert rides["ride_no"]["is_key"] and not rides["station"]["is_key"] and not rides["km"]["is_key"]
    assert {"bike", "subscribed"} <= {c for c, r in rides.items() if r["is_dimension"]}
    assert rides["station"]["samples"] == [r["station"] for r in ROWS[:3]]
    assert rides["rider_mail"]["pii_class"] == "email"
    assert by_column(rental, "mechanics")["name"]["pii_class"] == "name"


def test_silver_keeps_all_rows_and_conforms_dates(rental):
    silver = rental.table("silver", "rides")
    assert silver.count() == len(RIDES)
    assert dict(silver.dtypes)["ride_day"] == "date"


def test_gold_reconciles(rental, collect):
    fact = rental.table("gold", "agg_rides_daily")
    assert fact.columns == ["ride_day_day", "station", "bike", "subscribed", "fee", "km", "rides_count"]
    total = fact.agg(F.sum("fee").cast("double").alias("fee"), F.sum("km").alias("km"),
                     F.sum("rides_count").alias("n")).first()
    assert (round(total["fee"], 2), total["km"], total["n"]) == (FEES, sum(r["km"] for r in ROWS), len(RIDES))
    checks = [r for r in collect(rental.audit("quality")) if " reconciles " in r["check"]]
    assert len(checks) == 3 and all(c["result"] == "pass" for c in checks)


def test_dimension_has_no_personal_data(rental):
    assert rental.table("gold", "dim_mechanics").columns == ["mechanic_id", "shift", "error_rate", "certified"]


def test_proposed_and_authored_metrics(rental, collect):
    assert [m.metric for m in rental.metrics] == ["fee", "fee_per_ride", "km", "rides"]
    checked = {r["metric"]: r for r in collect(rental.conformance())}
    assert all(r["result"] == "pass" for r in checked.values())
    assert checked["fee_per_ride"]["guard_ok"] is False and checked["fee_per_ride"]["guard_strategy"] == "recompute"
    assert checked["fee"]["guard_ok"] is True and checked["fee"]["guard_strategy"] == "sum"
    assert "nullif(sum" in checked["fee_per_ride"]["definition"]


def test_questions_are_answered_with_receipts(rental, collect):
    asked = ["fee overall", "fee by station", "average ride fee by bike", "lowest fee by station",
             "top 2 km by bike", "fee by bike at Museum", "how is the weather?"]
    answers, receipts = answer_questions(rental.spark, rental.facts(), rental.metrics, asked)
    assert sorted(answers) == [1, 2, 3, 4, 5, 6]
    assert round(float(answers[1].first()["fee"]), 2) == FEES
    by_station = answers[2].collect()
    assert {r["station"]: float(r["fee"]) for r in by_station} == total_by("station")
    fees = [float(r["fee"]) for r in by_station]
    assert fees == sorted(fees, reverse=True)
    rides = total_by("bike", rows=ROWS)
    counts = {b: sum(r["bike"] == b for r in ROWS) for b in rides}
    assert {r["bike"]: r["fee_per_ride"] for r in answers[3].collect()} == {
        b: pytest.approx(sum(r["fee"] for r in ROWS if r["bike"] == b) / n) for b, n in counts.items()}
    assert float(answers[4].first()["fee"]) == pytest.approx(min(fees))
    assert len(answers[5].collect()) == 2
    museum = [r for r in ROWS if r["station"] == "Museum"]
    assert {r["bike"]: float(r["fee"]) for r in answers[6].collect()} == total_by("bike", rows=museum)
    notes = collect(receipts, "question_no")
    assert [n["metric"] for n in notes] == ["fee", "fee", "fee_per_ride", "fee", "km", "fee", None]
    assert notes[2]["note"] == "ratio recomputed from components"
    assert "nullif(sum" in notes[2]["definition"] and notes[2]["owner"] == "finance-desk"
    assert notes[5]["filters"] == [{"dim": "station", "value": "Museum"}]
    assert all(n["lineage"] == ["gold.agg_rides_daily"] for n in notes[:6])


def test_panels_and_roles(rental, collect):
    panels = rental.spark.read.parquet(f"{rental.base}/panels")
    kpis = {r["metric"]: r for r in collect(panels.where("kind = 'kpi'"))}
    assert round(kpis["fee"]["value"], 2) == FEES
    assert "viewer" in kpis["fee"]["visible_to"]
    breakdown = panels.where("kind = 'breakdown' and metric = 'fee'").orderBy("rank").collect()
    assert {r["dim_value"] for r in breakdown} == {r["station"] for r in ROWS}
    assert breakdown[0]["visible_to"] == ["admin", "analyst"]
    assert {"fee", "km", "rides"} <= {r["metric"] for r in collect(panels_for_role(panels, "viewer"))}
    assert {r["cadence"] for r in collect(panels)} == {"daily"}


def test_governance(rental, collect):
    report = rental.governance()
    verdict = collect(report["verdict"])[0]
    assert verdict == {"all_honored": True, "failed_checks": 0, "governed": True, "issues": []}
    register = {r["column"]: r for r in collect(report["pii"])}
    assert register["mechanics.name"]["disposition"] == "dropped in gold"
    assert register["rides.rider_mail"]["disposition"].startswith("flagged")
    assert register["mechanics.name"]["first_stage"] == "bronze"
    outputs = {r["output"].split(".")[0] for r in collect(report["outputs"])}
    assert outputs >= {"bronze", "silver", "gold", "metric", "panel"}
    assert {r["root"] for r in collect(report["roots"])} == {"file:mechanics.json", "file:rides.csv"}
    assert all(r["honored"] for r in collect(report["contracts"]))
    assert collect(report["conformance"])[0]["guarded"] == ["fee_per_ride"]
    total = next(r for r in collect(report["scoreboard"]) if r["stage"] == "total")
    assert total["fail"] == 0 and total["pass"] > 10
    policy = {r["role"]: r for r in collect(report["access_policy"])}
    assert policy["viewer"]["hidden_owners"] == ["finance-cdm", "payments-cdm"]


def test_monthly_ratio_is_not_the_sum_of_daily_ratios(rental):
    fact, _ = rental.facts()["agg_rides_daily"]
    ratio = next(m for m in rental.metrics if m.metric == "fee_per_ride")
    month = rollup_metric(fact, ratio, "monthly", "ride_day_day").first()["fee_per_ride"]
    assert round(month, 6) == round(FEES / len(RIDES), 6)
    daily = metric_query(fact, ratio, "ride_day_day", limit=None)
    assert round(daily.agg(F.sum("fee_per_ride")).first()[0], 2) != round(month, 2)


def test_reports_are_saved_and_audited(rental, collect):
    answers, receipts = rental.ask(["fee by station", "weather"])
    assert rental.spark.read.json(f"{rental.base}/reports/q1").count() == 4
    assert rental.spark.read.json(f"{rental.base}/reports/receipts").count() == 2
    checks = {r["check"]: r["result"] for r in collect(rental.audit("quality").where("stage = 'reports'"))}
    assert checks == {"Q1 answered": "pass", "Q2 answered": "warn"}
    assert {r["output"] for r in collect(rental.audit("lineage").where("stage = 'reports'"))} == {"report.q1"}
    answers, receipts = rental.ask([])
    assert [r["question"] for r in collect(receipts, "question_no")][:2] == ["Fee overall", "Fee per station"]
    assert len(answers) == 6 and {r["version"] for r in collect(receipts)} == {"v1"}
    assert collect(rental.governance()["verdict"])[0]["governed"] is True


def test_a_changed_definition_gets_a_new_version(rental, spark):
    from dataclasses import replace

    from smelter.plans import version_metrics
    store = spark.read.parquet(f"{rental.base}/metrics")
    changed = [replace(m, owner="someone") if m.metric == "fee_per_ride" else m for m in rental.metrics]
    numbered, new = version_metrics(spark, changed, store)
    assert {m.metric: m.version for m in numbered} == {"fee_per_ride": "v2", "fee": "v1", "km": "v1", "rides": "v1"}
    log = {r["metric"]: [e["change"] for e in r["changelog"]] for r in new.collect()}
    assert log["fee_per_ride"] == ["created", "definition changed"] and log["fee"] == ["created"]


def test_the_model_is_audited(kiosk, collect):
    model, evaluation = kiosk.learn("takings")
    assert model.trained_on == "gold.agg_kiosk_daily" and evaluation.count() == 2
    rows = collect(kiosk.audit("quality").where("stage = 'model'"))
    assert [(r["check"], r["result"]) for r in rows] == [("model predicts takings", "pass")]
    assert "model.takings" in {r["output"] for r in collect(kiosk.governance()["outputs"])}


def test_a_finished_run_is_opened_again(rental, collect):
    from smelter import open_run
    again = open_run(rental.spark, rental.base, "rental")
    assert [m.metric for m in again.metrics] == [m.metric for m in rental.metrics]
    assert sorted(c.table for c in again.contracts) == ["agg_rides_daily", "dim_mechanics"]
    answers, receipts = again.ask(["fee by station"], save=False)
    assert {r["station"]: float(r["fee"]) for r in answers[1].collect()} == total_by("station")
    assert collect(receipts)[0]["version"] == "v1"
    assert again.governance()["verdict"].first()["governed"] is True


def test_supplied_gold_starts_a_run(rental, tmp_path):
    from smelter import run_from_gold
    contracts = [c for c in rental.contracts if c.kind == "fact"]
    path = str(tmp_path / "supplied")
    rental.table("gold", "agg_rides_daily").write.parquet(path)
    run = run_from_gold(rental.spark, {"agg_rides_daily": path}, contracts, str(tmp_path / "run"))
    assert [m.metric for m in run.metrics] == ["fee", "km", "rides"]
    answers, _ = run.ask(["km overall"], save=False)
    assert answers[1].first()["km"] == sum(r["km"] for r in ROWS)
    days = run.fact_days("agg_rides_daily", "2025-03-11", "2025-03-13")
    assert days.agg(F.sum("rides_count")).first()[0] == sum("2025-03-11" <= r["ride_day"] <= "2025-03-13" for r in ROWS)
    scan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in scan
    model, evaluation = run.learn("fee")
    assert run.model("fee") == model and rental.spark.read.json(f"{run.base}/models/fee/evaluation").count() == evaluation.count()
