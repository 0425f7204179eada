"""Every registered query against its SQL, on the small test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from cohortwise import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = registry.all_queries(), registry.all_sql()
# Results without an SQL twin, tested on their own elsewhere.
NO_SQL: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def _text(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(
        tuple(_text(row[i]) for i in order) for row in data
    )


def test_sql_goes_with_queries():
    assert set(QUERIES) - set(SQL) == NO_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for pairing in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert pairing not in plan
    got = _rows(df.columns, df.collect())
    assert got[1]
    if name in SQL:
        found = duck.execute(SQL[name])
        assert got == _rows([c[0] for c in found.description], found.fetchall())


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


def test_entry(spark):
    df = entry_point.entry(spark)
    ratios = [r["AE_Ratio_Count"] for r in df.collect()]
    assert ratios and ratios == sorted(ratios, reverse=True)
