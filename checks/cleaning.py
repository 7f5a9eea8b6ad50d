"""Flattening, casts, dates, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.functions import (blank_to_null, flatten_nested, is_date, is_datetime, list_to_json, norm_date,
                               numeric_or_zero, stringify)
from smelter.operators import (cast_bronze, clean_silver, dedupe_all, dedupe_first, dedupe_receipt, version_diff)
from smelter.session import scratch_path
from smelter.streaming import dedupe_stream, first_rows

from .registry import as_text, query, table


@query("flatten_events_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k",
    event_type AS "meta.kind", value AS "meta.amount" FROM events""")
def flatten_events_props(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "struct<k:bigint>").alias("props"),
        F.struct(F.col("event_type").alias("kind"), F.col("value").alias("amount")).alias("meta"))
    return flatten_nested(nested)


@query("list_to_json_embeddings", """SELECT vec_id, CAST(to_json(list_transform(embedding,
    lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))) AS VARCHAR) AS embedding FROM embeddings""")
def list_to_json_embeddings(spark, sf_dir):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", list_to_json(rounded).alias("embedding"))


@query("stringify_conversations", """SELECT conv_id, turn, coalesce(CAST(CASE WHEN role <> 'system' THEN turn END
    AS VARCHAR), '') AS reply_no, CASE WHEN role = 'user' THEN 'true' ELSE 'false' END AS from_user FROM conversations""")
def stringify_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", stringify(F.when(F.col("role") != "system", F.col("turn"))).alias("reply_no"),
        stringify(F.col("role") == "user").alias("from_user"))


@query("bronze_cast_lineitem", """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus = 'O' AS l_open,
    CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem""")
def bronze_cast_lineitem(spark, sf_dir):
    raw = as_text(table(spark, sf_dir, "lineitem")).withColumn(
        "l_open", F.when(F.col("l_linestatus") == "O", " Yes ").otherwise("no")).drop("l_linestatus")
    types = {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
             "l_quantity": "real", "l_extendedprice": "real", "l_discount": "real", "l_tax": "real",
             "l_returnflag": "text", "l_shipdate": "datetime", "l_open": "boolean"}
    return cast_bronze(raw, types)


@query("clean_blank_part", """SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_brand END AS p_brand, p_type FROM part""")
def clean_blank_part(spark, sf_dir):
    blank = F.when(F.col("p_size") < 5, F.lit("")).when(F.col("p_size") < 10, F.lit(" \t "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", blank_to_null(F.coalesce(blank, F.concat(F.lit("  "), "p_brand", F.lit("\n")))).alias("p_brand"),
        blank_to_null(F.concat(F.lit(" "), "p_type")).alias("p_type"))


@query("numeric_or_zero_part", """SELECT p_partkey, CASE WHEN p_size > 20 THEN p_retailprice ELSE 0.0 END AS price
    FROM part""")
def numeric_or_zero_part(spark, sf_dir):
    text = F.when(F.col("p_size") > 20, F.col("p_retailprice").cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", numeric_or_zero(text).alias("price"))


def _rendered():
    """An order's date in a format that depends on its priority; one in five is no date."""
    day = F.col("o_orderdate")
    return (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "yyyy-M-d"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "dd/MM/yyyy"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(day, "MM/dd/yyyy"))
            .otherwise(F.concat(F.lit("week of "), F.date_format(day, "yyyy-MM-dd"))))


_RENDERED_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%-m-%-d')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%m/%d/%Y')
    ELSE 'week of ' || strftime(o_orderdate, '%Y-%m-%d') END"""


@query("norm_date_orders", f"""SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(v, '%Y-%m-%d'),
    try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d'), v) AS day,
    coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y')) IS NOT NULL AS is_date,
    try_strptime(v, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AS is_datetime
    FROM (SELECT o_orderkey, {_RENDERED_SQL} AS v FROM orders)""")
def norm_date_orders(spark, sf_dir):
    """Day-first wins over month-first where both are valid dates."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", _rendered().alias("v"))
    return df.select("o_orderkey", norm_date("v").alias("day"), is_date("v").alias("is_date"),
                     is_datetime("v").alias("is_datetime"))


_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
          "l_returnflag", "l_linestatus"]


@query("silver_dedupe_key", f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""")
def silver_dedupe_key(spark, sf_dir):
    return dedupe_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _ORDER)


@query("stream_dedupe_events", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, event_id) AS rn FROM events) WHERE rn = 1""")
def stream_dedupe_events(spark, sf_dir):
    """The first event of each user and kind, from a stream of two arrivals with a restart in between."""
    path = scratch_path(spark, "stream-first")
    events = table(spark, sf_dir, "events")
    middle = events.agg(F.timestamp_seconds(F.avg(F.unix_timestamp("ts"))).alias("m")).first()["m"]
    for arrival in ((F.col("ts") < F.lit(middle)) | F.col("ts").isNull(), F.col("ts") >= F.lit(middle)):
        events.where(arrival).write.mode("append").parquet(f"{path}/arrivals")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/arrivals")
        dedupe_stream(stream, ["user_id", "event_type"], path, f"{path}/checkpoint", ["ts", "event_id"]).awaitTermination()
    return first_rows(spark, path)


@query("silver_dedupe_receipt", """SELECT 'lineitem' AS "table", count(*) AS bronze_rows,
    count(DISTINCT (l_orderkey, l_linenumber)) AS silver_rows,
    count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dropped, 'pass' AS result FROM lineitem""")
def silver_dedupe_receipt(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return dedupe_receipt(lines, dedupe_first(lines, ["l_orderkey", "l_linenumber"], _ORDER), "lineitem")


@query("silver_dedupe_all", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def silver_dedupe_all(spark, sf_dir):
    return dedupe_all(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))


@query("silver_clean_orders", f"""SELECT o_orderkey, CAST(coalesce(try_strptime(v, '%Y-%m-%d'),
    try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%Y-%m-%dT%H:%M:%SZ')) AS DATE) AS day,
    o_orderstatus, o_totalprice FROM (SELECT *, {_RENDERED_SQL} AS v FROM orders)""")
def silver_clean_orders(spark, sf_dir):
    """Every order arrives twice; the first copy is kept and its date conformed."""
    raw = as_text(table(spark, sf_dir, "orders").select("o_orderkey", _rendered().alias("day"), "o_orderstatus",
                                                        "o_totalprice"))
    types = {"o_orderkey": "integer", "day": "date", "o_orderstatus": "text", "o_totalprice": "real"}
    first = cast_bronze(raw, types).withColumn("_row_id", F.lit(0))
    twice = first.unionByName(first.withColumn("_row_id", F.lit(1)).withColumn("o_totalprice", F.lit(0.0)))
    return clean_silver(twice, types, ["o_orderkey"]).drop("_row_id")


def _standing(since: str, until: str) -> str:
    return f"""SELECT o_custkey, count(*) AS orders, max(o_orderpriority) AS top, min(o_orderstatus) AS low FROM orders
        WHERE o_orderdate >= TIMESTAMP '{since}' AND o_orderdate < TIMESTAMP '{until}' GROUP BY o_custkey"""


_OLD, _NEW = _standing("1990-01-01", "2000-01-01"), _standing("1995-06-01", "2100-01-01")


@query("version_diff", f"""SELECT coalesce(c.o_custkey, p.o_custkey) AS o_custkey, c.orders, c.top, c.low,
    CASE WHEN p.o_custkey IS NULL THEN 'created' WHEN c.o_custkey IS NULL THEN 'removed'
         WHEN (c.orders, c.top, c.low) = (p.orders, p.top, p.low) THEN 'unchanged' ELSE 'changed' END AS status,
    CASE WHEN p.o_custkey IS NOT NULL AND c.o_custkey IS NOT NULL AND (c.orders, c.top, c.low) <> (p.orders, p.top, p.low)
         THEN 2 ELSE 1 END AS version,
    CASE WHEN p.o_custkey IS NOT NULL AND c.o_custkey IS NOT NULL AND (c.orders, c.top, c.low) <> (p.orders, p.top, p.low)
         THEN 'created,definition changed' ELSE 'created' END AS changes
    FROM ({_NEW}) c FULL OUTER JOIN ({_OLD}) p ON c.o_custkey = p.o_custkey""")
def version_diff_customers(spark, sf_dir):
    """Customer standing in two periods, compared by content."""
    orders = table(spark, sf_dir, "orders")

    def standing(since: str, until: str):
        day = F.col("o_orderdate")
        return (orders.where((day >= F.to_timestamp_ntz(F.lit(since))) & (day < F.to_timestamp_ntz(F.lit(until))))
                .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("top"),
                                          F.min("o_orderstatus").alias("low")))

    diff = version_diff(standing("1990-01-01", "2000-01-01"), standing("1995-06-01", "2100-01-01"), "o_custkey")
    return diff.withColumn("changes", F.array_join("changelog.change", ",")).drop("changelog", "content_hash")


@query("union_ragged_names", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def union_ragged_names(spark, sf_dir):
    from smelter.sources import union_ragged
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                        F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                                        F.col("s_nationkey").alias("nation"))
    return union_ragged([customers, suppliers])
