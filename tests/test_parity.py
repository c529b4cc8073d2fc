"""Every registered query against its SQL, on the small generated tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from haulcost.plans import catalogue, checks

FOLDER = os.environ.get("HAULCOST_TESTDATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no generated tables")
QUERIES = catalogue.queries()
SQL = checks.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "documents"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, Decimal):
        return (False, "decimal", str(value))
    return (value is None, type(value).__name__, value if value is not None else 0)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(comparable(row[i]) for i in order) for row in rows])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, engine, name):
    frame = QUERIES[name](spark, FOLDER)
    found = table(frame.columns, [tuple(row) for row in frame.collect()])
    result = engine.sql(SQL[name])
    expected = table(result.columns, result.fetchall())
    assert sorted(frame.columns) == sorted(result.columns)
    assert found, "the check would be empty"
    assert found == expected
