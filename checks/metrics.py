"""Metrics over gold facts, roll-ups, queries, question routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.functions import format_metric, rounded_total
from smelter.operators import dim_values, metric_query, rollup_metric, route_questions, value_rows
from smelter.plans import Metric
from smelter.sources import land_table, load_gold
from smelter.session import scratch_path

from .gold import (EVENTS_FACT_SQL, LINEITEM_FACT_SQL, NUDGE, ORDERS_FACT_SQL, events_fact, lineitem_fact, orders_fact, rounded)
from .registry import query, table

ORDERS = {"daily": "gold.agg_orders_daily"}
LINES = {"daily": "gold.agg_lineitem_daily"}

SALES = Metric("sales", "sum", measure="o_totalprice", label="Sales", rollups=ORDERS, round=2)
ORDER_COUNT = Metric("orders", "sum", measure="orders_count", label="Orders", rollups=ORDERS, round=0)
CELLS = Metric("cells", "count", rollups=ORDERS)
DAYS = Metric("days", "count_distinct", measure="o_orderdate_day", rollups=ORDERS)
AOV = Metric("aov", "ratio", numerator="o_totalprice", denominator="orders_count", label="Average Order Value",
             rollups=ORDERS, owner="finance-cdm", round=2)
LOW = Metric("lowest", "min", measure="o_totalprice", rollups=ORDERS)
HIGH = Metric("highest", "max", measure="o_totalprice", rollups=ORDERS)
MEAN = Metric("mean", "avg", measure="o_totalprice", count_col="orders_count", rollups=ORDERS)
MEAN_OF_CELLS = Metric("mean_of_cells", "avg_of_rows", measure="o_totalprice", rollups=ORDERS)
UNIT_PRICE = Metric("unit_price", "derived", expression="sum(l_extendedprice) / sum(l_quantity)", rollups=LINES)


def _by(metric_sql: str, name: str, dim: str, fact: str, places: int | None = None) -> str:
    nudge = f" + {NUDGE}" if places == 4 else ""
    value = f"round({metric_sql}{nudge}, {places})" if places is not None else metric_sql
    return f"SELECT {dim}, {value} AS {name} FROM ({fact}) GROUP BY {dim}"


@query("metric_sum", _by("sum(o_totalprice)", "sales", "o_orderstatus", ORDERS_FACT_SQL, 2))
def metric_sum(spark, sf_dir):
    return rounded(metric_query(orders_fact(spark, sf_dir), SALES, "o_orderstatus", limit=None), "sales")


@query("metric_count", _by("count(*)", "cells", "o_orderpriority", ORDERS_FACT_SQL))
def metric_count(spark, sf_dir):
    return metric_query(orders_fact(spark, sf_dir), CELLS, "o_orderpriority", limit=None)


@query("metric_count_distinct", _by("count(DISTINCT o_orderdate_day)", "days", "o_orderstatus", ORDERS_FACT_SQL))
def metric_count_distinct(spark, sf_dir):
    return metric_query(orders_fact(spark, sf_dir), DAYS, "o_orderstatus", limit=None)


@query("metric_minmaxavg", f"""SELECT o_orderpriority, round(min(o_totalprice), 2) AS lowest,
    round(max(o_totalprice), 2) AS highest, round(sum(o_totalprice) / sum(orders_count) + {NUDGE}, 4) AS mean,
    round(avg(o_totalprice) + {NUDGE}, 4) AS mean_of_cells FROM ({ORDERS_FACT_SQL}) GROUP BY o_orderpriority""")
def metric_minmaxavg(spark, sf_dir):
    from smelter.plans import metric_column
    wanted = orders_fact(spark, sf_dir).groupBy("o_orderpriority").agg(
        *[metric_column(m) for m in (LOW, HIGH, MEAN, MEAN_OF_CELLS)])
    return rounded(rounded(wanted, "lowest", "highest"), "mean", "mean_of_cells", places=4, nudge=NUDGE)


@query("metric_ratio", _by("sum(o_totalprice) / nullif(sum(orders_count), 0)", "aov", "o_orderstatus", ORDERS_FACT_SQL, 4))
def metric_ratio(spark, sf_dir):
    return rounded(metric_query(orders_fact(spark, sf_dir), AOV, "o_orderstatus", limit=None), "aov", places=4, nudge=NUDGE)


@query("metric_derived", _by("sum(l_extendedprice) / sum(l_quantity)", "unit_price", "l_returnflag", LINEITEM_FACT_SQL, 4))
def metric_derived(spark, sf_dir):
    return rounded(metric_query(lineitem_fact(spark, sf_dir), UNIT_PRICE, "l_returnflag", limit=None), "unit_price",
                   places=4, nudge=NUDGE)


@query("metric_rounded_total", """SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS total,
    round(coalesce(sum(l_tax) FILTER (l_returnflag = 'Z'), 0), 2) AS nothing FROM lineitem""")
def metric_rounded_total(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        rounded_total("l_extendedprice", 2).alias("total"),
        rounded_total(F.when(F.col("l_returnflag") == "Z", F.col("l_tax")), 2).alias("nothing"))


@query("metric_formatted", f"""SELECT o_orderstatus, o_orderpriority, format('{{:,}}', CAST(round(sum(o_totalprice)) AS BIGINT))
    AS sales, regexp_replace(printf('%.2f', sum(orders_count) % 997 / 4.0), '\\.?0+$', '') AS small
    FROM ({ORDERS_FACT_SQL}) GROUP BY ALL""")
def metric_formatted(spark, sf_dir):
    totals = orders_fact(spark, sf_dir).groupBy("o_orderstatus", "o_orderpriority").agg(
        F.sum("o_totalprice").alias("sales"), (F.sum("orders_count") % 997 / 4.0).alias("small"))
    return totals.select("o_orderstatus", "o_orderpriority", format_metric("sales").alias("sales"),
                         format_metric("small").alias("small"))


def _period(unit: str, day: str) -> str:
    return f"CAST(date_trunc('{unit}', {day}) AS DATE) AS period"


@query("rollup_week", f"""SELECT {_period('week', 'o_orderdate_day')}, o_orderstatus, round(sum(o_totalprice), 2) AS sales
    FROM ({ORDERS_FACT_SQL}) GROUP BY ALL""")
def rollup_week(spark, sf_dir):
    return rounded(rollup_metric(orders_fact(spark, sf_dir), SALES, "weekly", "o_orderdate_day", ["o_orderstatus"]), "sales")


@query("rollup_month_ratio", f"""SELECT {_period('month', 'o_orderdate_day')}, o_orderpriority,
    round(sum(o_totalprice) / sum(orders_count) + {NUDGE}, 4) AS aov FROM ({ORDERS_FACT_SQL}) GROUP BY ALL""")
def rollup_month_ratio(spark, sf_dir):
    return rounded(rollup_metric(orders_fact(spark, sf_dir), AOV, "monthly", "o_orderdate_day", ["o_orderpriority"]), "aov",
                   places=4, nudge=NUDGE)


@query("rollup_quarter", f"""SELECT {_period('quarter', 'o_orderdate_day')}, round(min(o_totalprice), 2) AS lowest
    FROM ({ORDERS_FACT_SQL}) GROUP BY ALL""")
def rollup_quarter(spark, sf_dir):
    return rounded(rollup_metric(orders_fact(spark, sf_dir), LOW, "quarterly", "o_orderdate_day"), "lowest")


@query("rollup_year", f"""SELECT {_period('year', 'l_shipdate_day')}, l_returnflag,
    round(sum(l_extendedprice) / sum(l_quantity) + {NUDGE}, 4) AS unit_price FROM ({LINEITEM_FACT_SQL}) GROUP BY ALL""")
def rollup_year(spark, sf_dir):
    return rounded(rollup_metric(lineitem_fact(spark, sf_dir), UNIT_PRICE, "yearly", "l_shipdate_day", ["l_returnflag"]),
                   "unit_price", places=4, nudge=NUDGE)


@query("rollup_average", f"""SELECT {_period('month', 'o_orderdate_day')}, round(sum(o_totalprice) / sum(orders_count) + {NUDGE}, 4)
    AS mean FROM ({ORDERS_FACT_SQL}) GROUP BY ALL""")
def rollup_average(spark, sf_dir):
    return rounded(rollup_metric(orders_fact(spark, sf_dir), MEAN, "monthly", "o_orderdate_day"), "mean", places=4, nudge=NUDGE)


@query("rollup_distinct_sketch", """SELECT CAST(date_trunc('month', ts) AS DATE) AS period, event_type,
    count(DISTINCT user_id) AS exact_users, true AS within_5pct FROM events GROUP BY ALL""")
def rollup_distinct_sketch(spark, sf_dir):
    """Sketches kept per day and type, merged per month, against the exact count."""
    users = Metric("users", "count_distinct", measure="user_id")
    estimate = rollup_metric(events_fact(spark, sf_dir, ["user_id"]), users, "monthly", "ts_day", ["event_type"])
    exact = (table(spark, sf_dir, "events")
             .groupBy(F.date_trunc("month", F.col("ts")).cast("date").alias("period"), "event_type")
             .agg(F.count_distinct("user_id").alias("exact_users")))
    return estimate.join(exact, ["period", "event_type"]).select(
        "period", "event_type", "exact_users",
        (F.abs(F.col("users") - F.col("exact_users")) <= F.greatest(F.lit(1.0), F.col("exact_users") * 0.05))
        .alias("within_5pct"))


@query("query_total", f"SELECT round(sum(o_totalprice), 2) AS sales FROM ({ORDERS_FACT_SQL})")
def query_total(spark, sf_dir):
    return rounded(metric_query(orders_fact(spark, sf_dir), SALES), "sales")


@query("query_breakdown", f"""SELECT o_orderpriority, round(sum(o_totalprice) / sum(orders_count), 2) AS aov
    FROM ({ORDERS_FACT_SQL}) GROUP BY o_orderpriority ORDER BY aov DESC, o_orderpriority LIMIT 10""")
def query_breakdown(spark, sf_dir):
    return metric_query(orders_fact(spark, sf_dir), AOV, "o_orderpriority", rounded=True)


@query("query_filtered_topn", f"""SELECT o_orderdate_day, sum(orders_count)::BIGINT AS orders FROM ({ORDERS_FACT_SQL})
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_orderdate_day
    ORDER BY orders DESC, o_orderdate_day LIMIT 5""")
def query_filtered_topn(spark, sf_dir):
    return metric_query(orders_fact(spark, sf_dir), ORDER_COUNT, "o_orderdate_day",
                        [("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")], limit=5)


@query("query_bottomn", f"""SELECT l_shipdate_day, CAST(sum(lineitem_count) AS BIGINT) AS lines FROM ({LINEITEM_FACT_SQL})
    GROUP BY l_shipdate_day ORDER BY lines, l_shipdate_day LIMIT 3""")
def query_bottomn(spark, sf_dir):
    lines = Metric("lines", "sum", measure="lineitem_count", rollups=LINES)
    return metric_query(lineitem_fact(spark, sf_dir), lines, "l_shipdate_day", order="asc", limit=3)


@query("query_supplied_gold", f"""SELECT event_type, round(sum(value), 2) AS value FROM ({EVENTS_FACT_SQL})
    GROUP BY event_type""")
def query_supplied_gold(spark, sf_dir):
    """A fact that was stored earlier and is handed in as a path."""
    path = scratch_path(spark, "gold-events")
    land_table(events_fact(spark, sf_dir), path)
    value = Metric("value", "sum", measure="value")
    return rounded(metric_query(load_gold(spark, path), value, "event_type", limit=None), "value")


_DICTIONARY_SQL = " UNION ALL ".join(
    f"""SELECT '{d}' AS dim, string_agg(v, '|' ORDER BY v) AS "values" FROM (SELECT DISTINCT CAST({d} AS VARCHAR) AS v
        FROM ({f}) WHERE {d} IS NOT NULL)"""
    for d, f in (("o_orderstatus", ORDERS_FACT_SQL), ("o_orderpriority", ORDERS_FACT_SQL),
                 ("l_returnflag", LINEITEM_FACT_SQL), ("l_linestatus", LINEITEM_FACT_SQL),
                 ("event_type", EVENTS_FACT_SQL)))


@query("dim_values", _DICTIONARY_SQL)
def dimension_values(spark, sf_dir):
    values = dim_values([(orders_fact(spark, sf_dir), ["o_orderstatus", "o_orderpriority"]),
                         (lineitem_fact(spark, sf_dir), ["l_returnflag", "l_linestatus"]),
                         (events_fact(spark, sf_dir), ["event_type"])])
    return values.withColumn("values", F.array_join("values", "|"))


@query("route_questions", """SELECT question,
    CASE WHEN what = 'Average Order Value' THEN 'aov' WHEN what = 'Sales' THEN 'sales' ELSE 'orders' END AS metric,
    CASE WHEN how <> 'What is total' THEN 'o_orderpriority' END AS breakdown,
    'o_orderpriority=' || o_orderpriority AS filters,
    CASE WHEN how = 'lowest 7' OR how = 'bottom 7' THEN 'asc' ELSE 'desc' END AS "order",
    CASE how WHEN 'What is total' THEN NULL WHEN 'bottom 7' THEN 7 WHEN 'top 3' THEN 3 ELSE 10 END AS "limit"
    FROM (SELECT DISTINCT o_orderpriority, what, how, how || ' ' || what || CASE WHEN how = 'What is total' THEN '' ELSE
        ' by o_orderpriority' END || ' for ' || o_orderpriority || ' in ' || CAST(year(o_orderdate) AS VARCHAR) || ' week ' ||
        CAST(dayofyear(o_orderdate) AS VARCHAR) AS question
        FROM orders, (VALUES ('Average Order Value'), ('Sales'), ('Orders')) m(what),
        (VALUES ('What is total'), ('top 3'), ('bottom 7'), ('lowest 7')) h(how))""")
def route_questions_orders(spark, sf_dir):
    """Questions made of every priority and day on which it was ordered."""
    orders = table(spark, sf_dir, "orders")
    asked = (orders.select("o_orderpriority", F.year("o_orderdate").alias("y"), F.dayofyear("o_orderdate").alias("d"))
             .distinct()
             .withColumn("what", F.explode(F.array(*[F.lit(m.label) for m in (AOV, SALES, ORDER_COUNT)])))
             .withColumn("how", F.explode(F.array(*[F.lit(h) for h in ("What is total", "top 3", "bottom 7", "lowest 7")])))
             .select(F.concat("how", F.lit(" "), "what",
                              F.when(F.col("how") == "What is total", "").otherwise(" by o_orderpriority"),
                              F.lit(" for "), "o_orderpriority", F.lit(" in "), F.col("y").cast("string"), F.lit(" week "),
                              F.col("d").cast("string")).alias("question")))
    values = value_rows([(orders, ["o_orderpriority"])])
    routed = route_questions(asked, [AOV, ORDER_COUNT, SALES], ["o_orderstatus", "o_orderpriority"], values)
    pairs = F.transform("filters", lambda f: F.concat(f["dim"], F.lit("="), f["value"]))
    return routed.withColumn("filters", F.array_join(pairs, ",")).drop("answered", "unresolved")


@query("route_questions_many_values", """SELECT 'total sales for ' || c_name || ' please' AS question, 'sales' AS metric,
    'c_name=' || c_name AS filters, true AS answered FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL)
    UNION ALL SELECT 'total sales for nothing known', 'sales', '', false""")
def route_questions_many_values(spark, sf_dir):
    """A dimension of very many values: every customer name, asked for once, and one thing that is no value."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_name").isNotNull())
    asked = (customers.select("c_name").distinct()
             .select(F.concat(F.lit("total sales for "), "c_name", F.lit(" please")).alias("question"))
             .unionAll(spark.range(1).select(F.lit("total sales for nothing known").alias("question"))))
    routed = route_questions(asked, [SALES], ["c_name"], value_rows([(customers, ["c_name"])]))
    pairs = F.transform("filters", lambda f: F.concat(f["dim"], F.lit("="), f["value"]))
    return routed.select("question", "metric", F.array_join(pairs, ",").alias("filters"), "answered")
