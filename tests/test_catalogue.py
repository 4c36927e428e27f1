"""Every query with SQL against DuckDB on the smallest tables, value by value; registration; the flagship."""

import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((repr(plain([r[i] for i in order])) for r in found.fetchall()))
    assert sorted(repr(plain([r[c] for c in cols])) for r in got.collect()) == want


def test_all_queries_are_registered(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["brow", "bcol", "ssd"]
