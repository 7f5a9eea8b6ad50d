"""Audit tables derived from the data, and what they add up to."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.operators import (contract_rows, dedupe_first, dedupe_receipt, detect_pii, governance_verdict, inherit,
                               lineage_outputs, lineage_roots, pii_register, profile_columns, quality_checks,
                               quality_scoreboard, reconcile)
from smelter.session import durable, pinned

from .cleaning import _ORDER
from .gold import LINEITEM_FACT_SQL, ORDERS_FACT_SQL, lineitem_fact, orders_fact
from .profiling import QUALITY_TABLES, quality_sql
from .registry import as_text, query, table

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_RECONCILE = [("orders", ORDERS_FACT_SQL, "o_totalprice")] + [("lineitem", LINEITEM_FACT_SQL, m) for m in _MEASURES]
_QUALITY_SQL = (
    "SELECT 'bronze' AS stage, 0 AS stage_no, \"check\", result FROM ("
    + " UNION ALL ".join(quality_sql(n, c) for n, c in QUALITY_TABLES.items())
    + ") UNION ALL SELECT 'silver', 1, 'silver.lineitem dedupe', 'pass' FROM lineitem HAVING count(*) > 0"
    # A complete order has a line; the fixed share of orders without one makes this check fail.
    + """ UNION ALL SELECT 'silver', 1, 'orders.' || o_orderpriority || ' have lines',
        CASE WHEN count(l.l_orderkey) = count(*) THEN 'pass' ELSE 'fail' END
        FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey
        GROUP BY o_orderpriority"""
    + "".join(f""" UNION ALL SELECT 'gold', 2, 'gold.agg_{t}_daily reconciles {m}', CASE WHEN
        (SELECT sum(CAST({m} AS DECIMAL(28,6))) FROM {t}) = (SELECT sum(CAST({m} AS DECIMAL(28,6))) FROM ({f}))
        THEN 'pass' ELSE 'fail' END""" for t, f, m in _RECONCILE))


def _quality(spark, sf_dir):
    """Quality rows of three stages: profiles, de-duplication and completeness, reconciliation."""
    profiles = inherit(*[profile_columns(as_text(table(spark, sf_dir, n)), n, by_column=True) for n in QUALITY_TABLES])
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bronze = quality_checks(profiles).select(F.lit("bronze").alias("stage"), F.lit(0).alias("stage_no"), "check", "result")
    receipt = dedupe_receipt(lines, dedupe_first(lines, ["l_orderkey", "l_linenumber"], _ORDER), "lineitem")
    silver = receipt.select(F.lit("silver").alias("stage"), F.lit(1).alias("stage_no"),
                            F.concat(F.lit("silver."), "table", F.lit(" dedupe")).alias("check"), "result")
    has_line = lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("line", F.lit(1))
    complete = (orders.join(has_line, "o_orderkey", "left").groupBy("o_orderpriority")
                .agg((F.count("line") == F.count(F.lit(1))).alias("ok"))
                .select(F.lit("silver").alias("stage"), F.lit(1).alias("stage_no"),
                        F.concat(F.lit("orders."), "o_orderpriority", F.lit(" have lines")).alias("check"),
                        F.when(F.col("ok"), "pass").otherwise("fail").alias("result")))
    # A fact is read more than once: it is stored, as gold is, and not built anew each time.
    sums = reconcile(orders, durable(orders_fact(spark, sf_dir)), ["o_totalprice"]).withColumn("t", F.lit("orders")).unionByName(
        reconcile(lines, durable(lineitem_fact(spark, sf_dir)), _MEASURES).withColumn("t", F.lit("lineitem")))
    gold = sums.select(F.lit("gold").alias("stage"), F.lit(2).alias("stage_no"),
                       F.concat(F.lit("gold.agg_"), "t", F.lit("_daily reconciles "), "measure").alias("check"), "result")
    return inherit(bronze, silver, complete, gold)


@query("audit_quality", _QUALITY_SQL)
def audit_quality(spark, sf_dir):
    return _quality(spark, sf_dir)


@query("quality_scoreboard", f"""SELECT coalesce(stage, 'total') AS stage, count_if(result = 'pass')::BIGINT AS "pass",
    count_if(result = 'warn')::BIGINT AS warn, count_if(result = 'fail')::BIGINT AS fail
    FROM ({_QUALITY_SQL}) GROUP BY ROLLUP (stage)""")
def scoreboard(spark, sf_dir):
    return quality_scoreboard(_quality(spark, sf_dir))


_CONTRACT_SQL = f"""SELECT stage, stage_no, 'retail.' || stage || '@1' AS name, count_if(result = 'fail') = 0 AS honored,
    coalesce(string_agg("check", ';' ORDER BY "check") FILTER (result = 'fail'), '') AS violations
    FROM ({_QUALITY_SQL}) GROUP BY stage, stage_no"""


@query("contract_rows", _CONTRACT_SQL)
def contracts(spark, sf_dir):
    return contract_rows(_quality(spark, sf_dir), "retail").withColumn("violations", F.array_join("violations", ";"))


@query("governance_verdict", f"""SELECT bool_and(honored) AS all_honored,
    (SELECT count_if(result = 'fail') FROM ({_QUALITY_SQL}))::BIGINT AS failed_checks,
    bool_and(honored) AND (SELECT count_if(result = 'fail') FROM ({_QUALITY_SQL})) = 0 AS governed FROM ({_CONTRACT_SQL})""")
def verdict(spark, sf_dir):
    quality = pinned(_quality(spark, sf_dir))  # a few rows per table and stage
    return governance_verdict(contract_rows(quality, "retail"), quality).drop("issues")


def _edges(spark, sf_dir):
    """Order lines come from an order, a part and a supplier; orders come from a customer."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")

    def node(kind: str, key: str):
        return F.concat(F.lit(f"{kind}."), F.col(key).cast("string"))

    return inherit(
        lines.select(F.concat_ws(".", F.lit("line"), "l_orderkey", "l_linenumber").alias("output"),
                     F.array(node("order", "l_orderkey"), node("part", "l_partkey"), node("supplier", "l_suppkey"))
                     .alias("sources")),
        orders.select(node("order", "o_orderkey").alias("output"), F.array(node("customer", "o_custkey")).alias("sources")))


_NODES = """SELECT 'order.' || l_orderkey AS n FROM lineitem UNION SELECT 'part.' || l_partkey FROM lineitem
    UNION SELECT 'supplier.' || l_suppkey FROM lineitem UNION SELECT 'customer.' || o_custkey FROM orders"""
_OUTPUTS = """SELECT 'line.' || l_orderkey || '.' || l_linenumber AS n FROM lineitem
    UNION SELECT 'order.' || o_orderkey FROM orders"""


@query("lineage_roots", f"SELECT n AS root FROM ({_NODES}) EXCEPT SELECT n FROM ({_OUTPUTS})")
def roots(spark, sf_dir):
    return lineage_roots(_edges(spark, sf_dir))


@query("lineage_outputs", f"SELECT n AS output FROM ({_OUTPUTS})")
def outputs(spark, sf_dir):
    return lineage_outputs(_edges(spark, sf_dir))


@query("pii_register", """SELECT 'customer.customer_name' AS "column", 'name' AS class, 'bronze' AS first_stage,
    'dropped in gold' AS disposition FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'supplier.mobile', 'phone', 'bronze', 'flagged, carried forward' FROM supplier HAVING count(*) > 0""")
def register(spark, sf_dir):
    """Customer and supplier columns flagged at bronze, carried on by silver, names dropped on the way to gold."""
    customer = as_text(table(spark, sf_dir, "customer").withColumnRenamed("c_name", "customer_name"))
    supplier = as_text(table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "mobile"))
    found = inherit(*[detect_pii(df, pinned(profile_columns(df, name)), name)
                      for df, name in ((customer, "customer"), (supplier, "supplier"))])
    flagged = found.select(F.concat_ws(".", "table", "column").alias("column"), "class", "action")
    stages = inherit(flagged.withColumns({"stage": F.lit("bronze"), "stage_no": F.lit(0)}),
                     flagged.withColumns({"stage": F.lit("silver"), "stage_no": F.lit(1)}))
    dropped = found.where(F.col("class") == "name").select("table", "column")
    return pii_register(stages, dropped)
