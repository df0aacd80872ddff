"""Running aggregates, quantiles and lists: the ranged path must agree with a plain computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import annotate, lists, ordered, relational, sampling


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    return [(draw.choice("aab"), i, float(draw.randint(1, 9))) for i in range(400)]


@pytest.mark.parametrize("limit", [10_000, 40])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_sum_product_min(spark, rows, limit, reverse):
    df = spark.createDataFrame([(k, i, v, 1 + v / 1000) for k, i, v in rows], "k string, i int, v double, f double")
    measures = {"s": ("sum", "v"), "p": ("product", "f"), "m": ("min", "v"), "b": ("sum_before", "v"), "q": ("product_before", "f")}
    got = {(r.k, r.i): r for r in ordered.running(df, ["k"], ["i"], measures, reverse, rows_per_window=limit).collect()}
    assert len(got) == len(rows)
    for key in "ab":
        mine = sorted([r for r in rows if r[0] == key], key=lambda r: r[1], reverse=reverse)
        total, product, low = 0.0, 1.0, float("inf")
        for _, i, v in mine:
            assert got[key, i].b == pytest.approx(total) and got[key, i].q == pytest.approx(product)
            total, product, low = total + v, product * (1 + v / 1000), min(low, v)
            assert (got[key, i].s, got[key, i].m) == (pytest.approx(total), low)
            assert got[key, i].p == pytest.approx(product)


@pytest.mark.parametrize("limit", [10_000, 30])
def test_numbers_over_text_order(spark, limit):
    names = [f"n{i * 7919 % 1000:03d}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.rn for r in ordered.numbered(df.select(F.col("name")), [], ["name"], rows_per_window=limit).collect()}
    assert [got[n] for n in sorted(names)] == list(range(1, 301))


@pytest.mark.parametrize("limit", [10_000, 20])
def test_quantiles_match_linear_interpolation(spark, limit):
    draw = np.random.default_rng(1)
    data = {"a": draw.integers(0, 50, 500).astype(float), "b": draw.normal(size=77), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    for row in ordered.quantiles(df, ["k"], "v", {"q1": 0.1, "q7": 0.7}, rows_per_window=limit).collect():
        assert row.q1 == pytest.approx(np.quantile(data[row.k], 0.1))
        assert row.q7 == pytest.approx(np.quantile(data[row.k], 0.7))
    whole = ordered.quantiles(df, [], "v", {"mid": 0.5}, rows_per_window=limit).head()
    assert whole.mid == pytest.approx(np.median(np.concatenate(list(data.values()))))


def test_long_lists_continue_in_parts_without_loss(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), "id")
    parts = lists.collected_parts(df, ["k"], "ids", F.col("id"), part_length=100).collect()
    hot = [r for r in parts if r.k == "hot"]
    assert len(hot) == 9 and max(len(r.ids) for r in hot) < 200
    assert sorted(i for r in hot for i in r.ids) == list(range(900))
    assert [r.ids for r in parts if r.k == "cold"] == [list(range(900, 1000))]


def test_a_repeated_value_is_split_and_kept_whole(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 950, 7).otherwise(F.col("id")).alias("v"))
    parts = lists.collected_parts(df, ["k"], "vs", F.col("v"), part_length=100).collect()
    assert len(parts) > 3 and sorted(v for r in parts for v in r.vs) == [7] * 950 + list(range(950, 1000))


def test_counts_of_long_lists_are_those_of_the_whole_key(spark, monkeypatch):
    monkeypatch.setattr(lists.collected_parts, "__defaults__", (100, None))
    links = spark.range(250).selectExpr("'g' AS gene", "concat('E', id) AS entry", "'reviewed' AS reviewed", "concat(id, ';x') AS pdb")
    rows = annotate.structure_ids(links).collect()
    assert len(rows) > 1 and {r.pdb_count for r in rows} == {251}
    one = lists.one_row_per_key(annotate.structure_ids(links), "gene", ["entries", "pdb_ids"]).collect()
    assert len(one) == 1 and one[0].pdb_count == 251
    assert sorted(one[0].pdb_ids.split(";")) == sorted([*map(str, range(250)), "x"])
    assert sorted(one[0].entries.split(";")) == sorted(f"E{i}" for i in range(250))
    assert {r.n for r in relational.joined_text(links, "gene", "entry").collect()} == {250}
    long = spark.range(250).selectExpr("'g' AS gene", "'c' AS category", "concat('p', id) AS partner", "1 AS score", "'t' AS interaction_type")
    drugs = annotate.drug_interactions(annotate.nested_terms(long)).collect()
    assert len(drugs) > 1 and {r.n_interactions for r in drugs} == {250}


def test_first_per_key_takes_the_smallest(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert {tuple(r) for r in lists.first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, None)}


def test_split_has_exact_size_and_ignores_partitioning(spark):
    df = spark.range(101).withColumnRenamed("id", "s")
    split = sampling.split_train_test(df, "s", 0.2, 21)
    again = sampling.split_train_test(df.repartition(7), "s", 0.2, 21)
    test = {r.s for r in split.where("part = 'test'").collect()}
    assert len(test) == 21 and test == {r.s for r in again.where("part = 'test'").collect()}


def test_folds_are_disjoint_and_balanced(spark):
    df = spark.range(95).select(F.col("id").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = sampling.repeated_stratified_folds(df, "s", "y", 5, 2, 331).collect()
    assert len(rows) == 190
    for repeat in (0, 1):
        for label in (0, 1):
            sizes = [sum(r.repeat == repeat and r.y == label and r.fold == f for r in rows) for f in range(5)]
            assert max(sizes) - min(sizes) <= 1
    assert {r.s: r.fold for r in rows if r.repeat == 0} != {r.s: r.fold for r in rows if r.repeat == 1}


def test_ranked_features_can_leave_out_the_best(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 9.0), ("c", 9.0), ("d", None)], "feature string, f double")
    assert [(r.feature, r.rank) for r in sampling.top_features(df, "f", "feature", 3).collect()] == [("b", 1), ("c", 2), ("a", 3)]
    assert [r.feature for r in sampling.top_features(df, "f", "feature", 3, skip_first=True).collect()] == ["c", "a"]


def test_batches_count_from_one(spark):
    got = [r.batch for r in sampling.batch_numbers(spark.range(450), "id", 200).orderBy("id").collect()]
    assert got == [1] * 200 + [2] * 200 + [3] * 50
