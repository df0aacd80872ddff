"""Queries that group or join by a key do it in partitions of bounded size, however large the tables are."""

import datetime

import pytest
from pyspark.sql.types import StructType

from cohortloom import runtime
from cohortloom.plans import catalog
from cohortloom.sources import writers


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """Orders and items; a partition is to hold 10 rows."""
    monkeypatch.setattr(runtime, "ROWS_PER_PARTITION", 10)
    orders = [(i, "F" if i % 2 else "O", datetime.datetime(1995, 1 + i % 12, 1 + i % 28)) for i in range(100)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp").selectExpr(
        "*", "'1-URGENT' AS o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    items = [(i // 5, i % 3, i % 7, i % 5, float(i % 11), 0.01 * (i % 10)) for i in range(500)]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double"
    spark.createDataFrame(items, schema).selectExpr("*", "l_discount AS l_tax", "l_quantity AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "a", "x")], "p_partkey bigint, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["join_inner_key", "agg_group_mean", "sink_append_scores"])
def test_number_of_partitions_follows_the_rows(spark, tables, name):
    assert catalog.QUERIES[name](spark, tables).rdd.getNumPartitions() >= 10


def test_joined_rows(spark, tables):
    rows = catalog.QUERIES["join_inner_key"](spark, tables).collect()
    assert len(rows) == 500 and {r.os for r in rows if r.sample % 2} == {1}
    assert {(r.sample, r.feature): r.x for r in rows} == {(i // 5, f"Feature{i % 5}"): float(i % 11) for i in range(500)}


def test_mean_of_the_probes_of_a_gene(spark, tables):
    got = {(r.sample, r.gene): r.value for r in catalog.QUERIES["agg_group_mean"](spark, tables).collect()}
    cells: dict = {}
    for i in range(500):
        key = (i % 7, i % 3)
        cells[key] = cells.get(key, 0.0) + (i % 11 if 0.01 * (i % 10) >= 0.05 else 0)
    # The probe of part 0 has no gene of its own (its number is a multiple of 11), so it goes by '.'.
    for sample in range(7):
        assert got[f"S{sample}", "."] == pytest.approx(cells[sample, 0])
        assert got[f"S{sample}", "b|x"] == pytest.approx(cells[sample, 1])
        assert got[f"S{sample}", "a|x"] == pytest.approx(cells[sample, 2])


def test_rows_of_a_run_without_id_are_replaced_too(spark, tmp_path):
    schema = StructType.fromDDL("run_id long, silhouette double")
    for rows in ([(1, 0.1), (None, 0.2)], [(None, 0.3), (2, 0.4)]):
        writers.append_scores(spark.createDataFrame(rows, schema), f"{tmp_path}/scores")
    assert {tuple(r) for r in writers.read_scores(spark, f"{tmp_path}/scores", schema).collect()} == {(1, 0.1), (None, 0.3), (2, 0.4)}
