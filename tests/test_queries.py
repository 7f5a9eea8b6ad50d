"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as driver
from checks import ORACLES, QUERIES
from checks.verify import compare_frame, duck

SF_DIR = os.environ.get("SMELTER_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
# The operators of the optional subpackage have tests of their own.


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan
    ok, message = compare_frame(df, con, ORACLES.get(name))
    assert ok, message


def test_every_query_has_sql():
    assert not set(QUERIES) - set(ORACLES)


def plan_of(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(spark, "query_filtered_topn")
    assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "TakeOrderedAndProject" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "row_number(), 10, Partial" in plan_of(spark, "breakdown_panels")
    assert "row_number(), 1, Partial" in plan_of(spark, "silver_dedupe_key")


def test_a_fact_shuffles_once(spark):
    assert plan_of(spark, "gold_lineitem_daily").count("Exchange") == 1
    assert plan_of(spark, "profile_lineitem").count("Exchange hashpartitioning") == 2


def test_entry(spark):
    assert driver.entry(spark).count() == 3
