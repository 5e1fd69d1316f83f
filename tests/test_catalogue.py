"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables, if those are there."""

import math
import os

import duckdb
import pytest

from lodestore import catalogue, sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "documents embeddings pages benchmark labels conversations events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from '{SF_DIR}/{n}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        return round(float(x), 5)
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR)
    want = duck.sql(sql.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(sql.SQL)))
def test_others_return_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert {"query_id", "path", "score", "rank"} <= set(got.columns)
    assert set(e.oracle_sql()) <= set(e.queries())
