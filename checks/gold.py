"""Daily facts, dimensions, reconciliation, streaming refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.operators import build_daily_fact, conform_dimension, mask_pii, reconcile, reconcile_rows
from smelter.session import scratch_path
from smelter.streaming import compact_fact, current_fact, refresh_fact_from_stream

from .registry import query, table

ORDERS_FACT_SQL = """SELECT CAST(o_orderdate AS DATE) AS o_orderdate_day, o_orderstatus, o_orderpriority,
    sum(o_totalprice) AS o_totalprice, count(*) AS orders_count FROM orders GROUP BY ALL"""
LINEITEM_FACT_SQL = """SELECT CAST(l_shipdate AS DATE) AS l_shipdate_day, l_returnflag, l_linestatus,
    sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice, sum(l_discount) AS l_discount,
    sum(l_tax) AS l_tax, count(*) AS lineitem_count FROM lineitem GROUP BY ALL"""
EVENTS_FACT_SQL = """SELECT CAST(ts AS DATE) AS ts_day, event_type, sum(value) AS value, count(*) AS events_count
    FROM events GROUP BY ALL"""


def orders_fact(spark, sf_dir):
    return build_daily_fact(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus", "o_orderpriority"],
                            ["o_totalprice"], "orders")


def lineitem_fact(spark, sf_dir):
    return build_daily_fact(table(spark, sf_dir, "lineitem"), "l_shipdate", ["l_returnflag", "l_linestatus"],
                            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")


def events_fact(spark, sf_dir, distinct_cols=()):
    return build_daily_fact(table(spark, sf_dir, "events"), "ts", ["event_type"], ["value"], "events", distinct_cols)


NUDGE = 3.3e-7  # lifts quotients off the half-way points, where engines round differently


def rounded(df, *columns, places=2, nudge=0.0):
    return df.withColumns({c: F.round(F.col(c).cast("double") + nudge, places) for c in columns})


@query("gold_orders_daily", f"SELECT * REPLACE (round(o_totalprice, 2) AS o_totalprice) FROM ({ORDERS_FACT_SQL})")
def gold_orders_daily(spark, sf_dir):
    return rounded(orders_fact(spark, sf_dir), "o_totalprice")


@query("gold_lineitem_daily", f"""SELECT * REPLACE (round(l_quantity, 2) AS l_quantity,
    round(l_extendedprice, 2) AS l_extendedprice, round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax)
    FROM ({LINEITEM_FACT_SQL})""")
def gold_lineitem_daily(spark, sf_dir):
    return rounded(lineitem_fact(spark, sf_dir), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("gold_events_daily", f"SELECT * REPLACE (round(value, 2) AS value) FROM ({EVENTS_FACT_SQL})")
def gold_events_daily(spark, sf_dir):
    return rounded(events_fact(spark, sf_dir), "value")


@query("gold_dim_customer", "SELECT * EXCLUDE (c_name) FROM customer")
def gold_dim_customer(spark, sf_dir):
    return conform_dimension(table(spark, sf_dir, "customer"), ["c_name"])


@query("pii_disposition_customer", """SELECT c_custkey, c_nationkey, sha256('s' || c_name) AS c_name, c_mktsegment
    FROM customer""")
def pii_disposition_customer(spark, sf_dir):
    return mask_pii(table(spark, sf_dir, "customer"),
                    {"c_name": "masked", "c_acctbal": "dropped", "c_mktsegment": "flagged"}, salt="s")


def _reconcile_sql(source: str, fact: str, measures: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{m}' AS measure, CAST(s AS DOUBLE) AS silver_sum, CAST(g AS DOUBLE) AS gold_sum,
        CASE WHEN s = g THEN 'pass' ELSE 'fail' END AS result
        FROM (SELECT sum(CAST({m} AS DECIMAL(28,6))) AS s FROM {source}),
             (SELECT sum(CAST({m} AS DECIMAL(28,6))) AS g FROM ({fact}))""" for m in measures)


def _as_double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("silver_sum", "gold_sum")})


@query("reconcile_orders", _reconcile_sql("orders", ORDERS_FACT_SQL, ["o_totalprice"]))
def reconcile_orders(spark, sf_dir):
    return _as_double(reconcile(table(spark, sf_dir, "orders"), orders_fact(spark, sf_dir), ["o_totalprice"]))


@query("reconcile_lineitem_exact", _reconcile_sql("lineitem", LINEITEM_FACT_SQL, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def reconcile_lineitem_exact(spark, sf_dir):
    """A fact that keeps decimal sums reconciles to the last digit."""
    lines = table(spark, sf_dir, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    fact = build_daily_fact(lines, "l_shipdate", ["l_returnflag", "l_linestatus"], measures, "lineitem", exact=True)
    return _as_double(reconcile(lines, fact, measures, relative=0.0))


@query("reconcile_rows_events", """SELECT 'events_count' AS measure, count(*) AS silver_rows, count(*) AS gold_rows,
    'pass' AS result FROM events""")
def reconcile_rows_events(spark, sf_dir):
    return reconcile_rows(table(spark, sf_dir, "events"), events_fact(spark, sf_dir), "events_count")


_ARRIVALS_SQL = "(SELECT * REPLACE (CASE WHEN event_id % 50 <> 0 THEN ts END AS ts) FROM events)"


@query("stream_daily_fact", f"""SELECT CAST(ts AS DATE) AS ts_day, event_type, round(sum(value), 2) AS value,
    count(*) AS events_count FROM {_ARRIVALS_SQL} GROUP BY ALL""")
def stream_events_daily(spark, sf_dir):
    """The daily fact of the events as a stream of two arrivals, the later days first and some rows without a time;
    compacted between them; equal to the batch fact."""
    path = scratch_path(spark, "stream-fact")
    events = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    middle = events.agg(F.timestamp_seconds(F.avg(F.unix_timestamp("ts"))).alias("m")).first()["m"]
    for arrival in (F.col("ts") >= F.lit(middle), (F.col("ts") < F.lit(middle)) | F.col("ts").isNull()):
        events.where(arrival).write.mode("append").parquet(f"{path}/arrivals")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/arrivals")
        refresh_fact_from_stream(stream, "ts", ["event_type"], ["value"], "events", path, f"{path}/checkpoint").awaitTermination()
        compact_fact(spark, path, "ts_day", ["event_type"])
    return rounded(current_fact(spark, path, "ts_day", ["event_type"]), "value")


_SMALL_LINES_SQL = "(SELECT l_shipdate, l_returnflag, l_discount * 1e-7 AS tiny, l_extendedprice * 1e28 AS vast FROM lineitem)"


def _small_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_shipdate", "l_returnflag", (F.col("l_discount") * F.lit(1e-7)).alias("tiny"),
                        (F.col("l_extendedprice") * F.lit(1e28)).alias("vast"))


@query("gold_small_measures", f"""SELECT CAST(l_shipdate AS DATE) AS l_shipdate_day, l_returnflag,
    round(sum(tiny) * 1e9, 3) AS tiny, round(sum(vast) * 1e-28, 2) AS vast, count(*) AS lines_count
    FROM {_SMALL_LINES_SQL} GROUP BY ALL""")
def gold_small_measures(spark, sf_dir):
    """Measures far below a millionth and far beyond 38 digits keep their digits in the fact."""
    fact = build_daily_fact(_small_lines(spark, sf_dir), "l_shipdate", ["l_returnflag"], ["tiny", "vast"], "lines", exact=True)
    return fact.withColumns({"tiny": F.round(F.col("tiny") * 1e9, 3), "vast": F.round(F.col("vast") * 1e-28, 2)})


@query("reconcile_small_measures", f"""SELECT 'tiny' AS measure, round(sum(tiny) * 1e9, 2) AS silver_sum,
    round(sum(tiny) * 1e9, 2) AS gold_sum, 'pass' AS result FROM {_SMALL_LINES_SQL}
    UNION ALL SELECT 'vast', round(sum(vast) * 1e-28, 0), round(sum(vast) * 1e-28, 0), 'pass' FROM {_SMALL_LINES_SQL}
    UNION ALL SELECT 'tiny less a row', round(sum(tiny) * 1e9, 2), round((sum(tiny) - max(tiny)) * 1e9, 2), 'fail' FROM {_SMALL_LINES_SQL}""")
def reconcile_small_measures(spark, sf_dir):
    """The comparison sees what one row of the smallest measure makes, and stands values beyond decimals."""
    lines = _small_lines(spark, sf_dir)
    fact = build_daily_fact(lines, "l_shipdate", ["l_returnflag"], ["tiny", "vast"], "lines", exact=True)
    whole = reconcile(lines, fact, ["tiny", "vast"])
    loss = lines.agg(F.max("tiny").alias("tiny")).select((-F.col("tiny")).alias("tiny"))
    short = reconcile(lines, fact.select("tiny").unionByName(loss), ["tiny"]).withColumn("measure", F.lit("tiny less a row"))
    rows = whole.unionByName(short)
    shown = {c: F.when(F.col("measure") == "vast", F.round(F.col(c) * 1e-28, 0)).otherwise(F.round(F.col(c) * 1e9, 2))
             for c in ("silver_sum", "gold_sum")}
    return rows.withColumns(shown)
