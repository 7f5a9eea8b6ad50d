"""Panels and who sees them."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.operators import breakdown_panels, kpi_panels, panels_for_role, refresh_panels, visible_to

from .gold import LINEITEM_FACT_SQL, ORDERS_FACT_SQL, lineitem_fact, orders_fact, rounded
from .metrics import AOV, DAYS, HIGH, ORDER_COUNT, SALES, UNIT_PRICE
from .registry import query

_KPI = {"sales": "sum(o_totalprice)", "orders": "sum(orders_count)", "aov": "sum(o_totalprice) / sum(orders_count)",
        "highest": "max(o_totalprice)", "days": "count(DISTINCT o_orderdate_day)"}
_METRICS = [SALES, ORDER_COUNT, AOV, HIGH, DAYS]


@query("kpi_panels", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(CAST({e} AS DOUBLE), 2) AS value FROM ({ORDERS_FACT_SQL})" for m, e in _KPI.items()))
def kpi(spark, sf_dir):
    return rounded(kpi_panels(orders_fact(spark, sf_dir), _METRICS), "value")


def _breakdown_sql(expression: str, metric: str, fact: str, dim: str, top: int) -> str:
    return f"""SELECT '{metric}' AS metric, '{dim}' AS dim, CAST({dim} AS VARCHAR) AS dim_value,
        CAST(row_number() OVER (ORDER BY {expression} DESC, CAST({dim} AS VARCHAR)) AS INTEGER) AS rank,
        round(CAST({expression} AS DOUBLE), 2) AS value FROM ({fact}) GROUP BY {dim} QUALIFY rank <= {top}"""


@query("breakdown_panels", " UNION ALL ".join(_breakdown_sql(e, m, ORDERS_FACT_SQL, "o_orderdate_day", 10)
                                              for m, e in _KPI.items() if m != "days"))
def breakdown(spark, sf_dir):
    """The ten highest days of each metric."""
    panels = breakdown_panels(orders_fact(spark, sf_dir), [m for m in _METRICS if m is not DAYS], "o_orderdate_day")
    return rounded(panels, "value")


def _data_sql() -> str:
    kpis = " UNION ALL ".join(f"SELECT 'kpi' AS kind, '{m}' AS metric, NULL AS dim_value, 1 AS rank, "
                              f"round(CAST({e} AS DOUBLE), 2) AS value FROM ({ORDERS_FACT_SQL})" for m, e in _KPI.items())
    tops = " UNION ALL ".join(f"SELECT 'breakdown', metric, dim_value, rank, value FROM "
                              f"({_breakdown_sql(e, m, ORDERS_FACT_SQL, 'o_orderstatus', 10)})" for m, e in _KPI.items())
    unit = "sum(l_extendedprice) / sum(l_quantity)"
    lines = (f"SELECT 'kpi', 'unit_price', NULL, 1, round({unit}, 2) FROM ({LINEITEM_FACT_SQL}) UNION ALL "
             f"SELECT 'breakdown', metric, dim_value, rank, value FROM "
             f"({_breakdown_sql(unit, 'unit_price', LINEITEM_FACT_SQL, 'l_returnflag', 10)})")
    return f"{kpis} UNION ALL {tops} UNION ALL {lines}"


_SEEN = """CASE WHEN kind = 'breakdown' THEN 'admin,analyst' WHEN metric = 'aov' THEN 'admin,analyst,leadership'
    ELSE 'admin,analyst,leadership,viewer' END"""
_DATA = _data_sql()


def _panels(spark, sf_dir):
    facts = {"agg_orders_daily": (orders_fact(spark, sf_dir), ["o_orderstatus"]),
             "agg_lineitem_daily": (lineitem_fact(spark, sf_dir), ["l_returnflag"])}
    return refresh_panels(spark, facts, [*_METRICS, UNIT_PRICE])


@query("refresh_panels", f"""SELECT kind, metric, dim_value, rank, value, {_SEEN} AS visible_to, 'daily' AS cadence
    FROM ({_DATA})""")
def refreshed(spark, sf_dir):
    """All panels of two facts, recomputed, with their visibility."""
    return (rounded(_panels(spark, sf_dir), "value").withColumn("visible_to", F.array_join("visible_to", ","))
            .select("kind", "metric", "dim_value", "rank", "value", "visible_to", "cadence"))


@query("panels_for_viewer", f"""SELECT kind, metric, value FROM ({_DATA}) WHERE {_SEEN} LIKE '%viewer%'""")
def for_viewer(spark, sf_dir):
    return rounded(panels_for_role(_panels(spark, sf_dir), "viewer"), "value").select("kind", "metric", "value")


@query("panel_visibility", """SELECT o_orderkey, CASE
    WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'admin,analyst,regional' ELSE 'admin,analyst' END
    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'admin,analyst,leadership'
    ELSE 'admin,analyst,leadership,viewer' END AS visible_to FROM orders""")
def panel_visibility(spark, sf_dir):
    """Every order as a panel of its own: status P is a breakdown by its priority, urgent and high belong to
    restricted owners."""
    from smelter.operators import DEFAULT_ROLES

    from .registry import table
    panels = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "breakdown").otherwise("kpi").alias("kind"),
        F.col("o_orderpriority").alias("dim"), F.col("o_orderpriority").alias("owner"))
    roles = {**DEFAULT_ROLES, "regional": {"metrics": "*", "dims": ["1-URGENT"], "panels": ["breakdown"]}}
    seen = visible_to(panels, roles, ["1-URGENT", "2-HIGH"])
    return seen.select("o_orderkey", F.array_join("visible_to", ",").alias("visible_to"))
