"""Every registered query with SQL must equal DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from cohortloom.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, key):
    frame = catalog.QUERIES[key](spark, FOLDER)
    names, rows = check.sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(catalog.ORACLE[key])
    want_names, want = check.sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert names == want_names
    assert rows == want
