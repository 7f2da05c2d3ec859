"""The jobs over whole tables score sets of any size: these grow with the part table."""

import duckdb
import pytest
from compare import actual, differences, expected

from bindings.oracles import ORACLES
from bindings.queries import QUERIES

# 900 parts, two thirds with a symbol; all but 30 are of one brand, which has 580 genes, and the types have 60 each.
TABLES = {
    "region": "SELECT 0::INTEGER AS r_regionkey, 'REGION_0' AS r_name",
    "nation": "SELECT 0::INTEGER AS n_nationkey, 'NATION_0' AS n_name, 0::INTEGER AS n_regionkey",
    "customer": "SELECT 1::BIGINT AS c_custkey, 0::INTEGER AS c_nationkey, 'BUILDING' AS c_mktsegment",
    "supplier": "SELECT 1::BIGINT AS s_suppkey, 0::INTEGER AS s_nationkey",
    "part": "SELECT i AS p_partkey, 'part ' || i AS p_name, CASE WHEN i <= 870 THEN 'Brand#1' ELSE 'Brand#2' END AS p_brand, 'TYPE ' || (i % 10) AS p_type FROM range(1, 901) r(i)",
    "orders": "SELECT i AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus FROM range(1, 1001) r(i)",
    "lineitem": """
        SELECT i AS l_orderkey, 1::INTEGER AS l_linenumber, (i - 1) % 900 + 1 AS l_partkey, 1::BIGINT AS l_suppkey, 5.0::DOUBLE AS l_quantity,
               (900 + i * 37 % 5003)::DOUBLE AS l_extendedprice, CASE WHEN i <= 900 THEN 'F' ELSE 'O' END AS l_linestatus FROM range(1, 1001) r(i)""",
}


@pytest.fixture(scope="module")
def large_sets(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large-sets"))
    con = duckdb.connect()
    for name, rows in TABLES.items():
        con.execute(f"COPY ({rows}) TO '{path}/{name}.parquet'")
    views = duckdb.connect()
    for name in TABLES:
        views.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return path, views


@pytest.mark.parametrize("name, least", [("nes_pvalue", 12), ("prerank_scale", 12), ("index_and_enrich", 2)])
def test_sets_beyond_500_genes_are_scored(spark, large_sets, name, least):
    path, views = large_sets
    got = actual(QUERIES[name](spark, path))
    assert differences(got, expected(views, ORACLES[name])) == []
    columns, rows = got
    if "pathway" in columns:
        scored = {r[columns.index("pathway")] for r in rows if r[columns.index("nes")] is not None}
        assert "brand:Brand#1" in scored
    else:
        assert max(r[columns.index("n_pathways")] or 0 for r in rows) == 12
    assert len(rows) >= least
