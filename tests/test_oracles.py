"""Every query against its SQL on the sf0.01 tables."""

import pytest
from pyspark.sql import functions as F
from compare import actual, connect, differences, expected

import __spark_entry__ as entry
from bindings.oracles import ORACLES
from bindings.queries import QUERIES
from bindings.tables import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_no_input_is_cut(spark):
    t = Tables(spark, SF)
    customers = t.raw("customer").select("c_mktsegment", "c_nationkey", (F.col("c_custkey") % 20).alias("n"), (F.col("c_custkey") % 7 != 0).alias("known"))
    nation = F.when(F.col("known"), F.col("c_nationkey"))
    assert t.cells().count() == customers.select("c_mktsegment", nation, "n").distinct().count()
    assert t.external_names().count() == t.raw("part").count()


def test_facts_are_not_shuffled_for_customers(spark):
    """Customers are joined with the orders, whatever their number."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, SF)
        lines = t.de_from(t.raw("lineitem"))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    (at,) = [i for i, line in enumerate(lines) if "SortMergeJoin [o_custkey" in line]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    assert not any("l_extendedprice" in line for line in lines[at:below])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert differences(actual(QUERIES[name](spark, SF)), expected(duck, ORACLES[name])) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
