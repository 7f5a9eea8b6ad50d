"""Dotted columns of nested JSON lines all the way to panels and a model, beside a document source."""

import json

from pyspark.sql import functions as F

from smelter.plans.medallion import run_medallion


def test_nested_columns_reach_gold(spark, tmp_path, collect):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"id": i, "at": f"2024-01-{1 + i % 20:02d}T10:00:00", "shop": {"city": "ABC"[i % 3], "kind": {"tier": "XY"[i % 2]}},
             "sale": {"amount": 1.5 * i, "cost": i % 7}, "tags": ["a", i]} for i in range(60)]
    (folder / "sales.ndjson").write_text("\n".join(json.dumps(r) for r in rows))
    run = run_medallion(spark, [str(folder)], str(tmp_path / "out"), exact_profile=False, distinct_cols=["id"])
    contract = run.contracts[0]
    assert contract.grain == "at_day" and contract.dims == ["shop.city", "shop.kind.tier"]
    assert contract.measures == ["sale.amount", "sale.cost"]
    fact = run.table("gold", "agg_sales_daily")
    assert float(fact.agg(F.sum("`sale.amount`")).first()[0]) == sum(r["sale"]["amount"] for r in rows)
    assert fact.agg(F.hll_sketch_estimate(F.hll_union_agg("id_sketch"))).first()[0] in range(58, 63)
    assert run.governance()["verdict"].first()["governed"] is True
    answers, _ = run.ask(["sale.amount by shop.city"])
    assert {r["shop.city"] for r in collect(answers[1])} == {"A", "B", "C"}
    model, metrics = run.learn("sale.amount")
    assert metrics.count() == 2 and model.schema.numeric == ["sale.cost"]
