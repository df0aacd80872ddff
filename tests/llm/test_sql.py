"""Every training-data query with SQL must equal DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check  # noqa: E402

from cohortloom.llm import catalog  # noqa: E402


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, small, key):
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    frame = catalog.QUERIES[key](spark, small)
    names, rows = check.sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(catalog.ORACLE[key])
    want_names, want = check.sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert names == want_names and len(rows) == len(want)
    assert all(check.close(a, b) for x, y in zip(rows, want, strict=True) for a, b in zip(x, y, strict=True))
