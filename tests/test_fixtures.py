"""Model tables that Spark makes by another plan than their SQL."""

import os

import pytest

from factgraph.plans import fixtures

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_edges_are_those_of_their_sql(spark):
    named = {n: fixtures.load(spark, FOLDER, n) for n in ("trades", "customer", "supplier", "nation")}
    want, got = spark.sql(fixtures.MODELS["edges"], **named), fixtures.load(spark, FOLDER, "edges")
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_trades_are_grouped_where_they_are_dealt(spark):
    """Two shuffles of trades beside those of their join, and none of grouped rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.load(spark, FOLDER, "edges")._jdf.queryExecution().sparkPlan().toString()
        run = fixtures.load(spark, FOLDER, "edges")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(custkey") == 1 and plan.count("Exchange hashpartitioning(suppkey") == 1
    shuffles = [line for line in run.splitlines() if "Exchange hashpartitioning" in line]
    assert len([s for s in shuffles if "orderkey" not in s]) == 2
