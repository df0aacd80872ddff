"""Nearest neighbours: exact scores, ties, recall against all distances."""

import numpy as np
import pytest

from cohortloom.llm import ann, catalog


def brute(ids, points, own, k=10):
    distance = np.sqrt(((points - points[own]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, distance)) if i != own][:k]
    return [(int(ids[i]), float(distance[i])) for i in order]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_given_vectors(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").toPandas()
    ids, points = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), dtype=np.float64)
    got = catalog.QUERIES["op1_nearest_neighbours"](spark, f"/root/testdata/{folder}").toPandas()
    hits = n = 0
    for own in np.flatnonzero(ids % 100 == 0):
        want, found = brute(ids, points, own), got[got.query_id == ids[own]].sort_values("rank")
        assert found["rank"].tolist() == list(range(1, len(want) + 1)) and found.score.is_monotonic_increasing
        hits += len({v for v, _ in want} & set(found.vec_id))
        n += len(want)
        exact = np.sqrt(((points[[int(np.flatnonzero(ids == v)[0]) for v in found.vec_id]] - points[own]) ** 2).sum(1))
        assert np.array_equal(exact, found.score.to_numpy())
    assert hits / n >= 0.9


def test_unusable_vectors_ties_and_few_candidates(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
        (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [5.0, 0.0]), (100, [5.0, 0.0]), (200, []),
    ]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, row int, list string").coalesce(1)
    index = ann.build(vectors)
    got = ann.search(index, index.table.filter("vec_id % 100 = 0"), recall=1.0).orderBy("query_id", "rank").collect()
    assert [(g.vec_id, g.score) for g in got if g.query_id == 0] == [(1, 0.0), (2, 0.0), (3, 5**0.5), (100, 4.0), (100, 4.0)] or [
        (g.vec_id, g.score) for g in got if g.query_id == 0
    ] == sorted([(1, 0.0), (2, 0.0), (3, 5**0.5), (100, 4.0), (100, 4.0)], key=lambda x: (x[1], x[0]))
    assert len([g for g in got if g.query_id == 100]) == 10 and [g.score for g in got if g.query_id == 100][:2] == [0.0, 0.0]
    assert {g.query_id for g in got} == {0, 100}


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(2)
    points = [rng.standard_normal(3 if i % 4 == 0 else 5).tolist() for i in range(240)] + [[1.0]]
    vectors = spark.createDataFrame([(i if i < 240 else 300, p) for i, p in enumerate(points)], "vec_id long, embedding array<double>").coalesce(2)
    got = ann.nearest(vectors, "vec_id % 10 = 0", recall=1.0).toPandas()
    for own in range(0, 240, 10):
        same = np.array([i for i in range(240) if len(points[i]) == len(points[own])])
        found = got[got.query_id == own].sort_values("rank")
        assert list(zip(found.vec_id, found.score)) == brute(same, np.array([points[i] for i in same]), int(np.flatnonzero(same == own)[0]))
    assert not len(got[got.query_id == 300])  # the only one of its length


def test_a_large_group_of_equal_vectors(spark):
    rng = np.random.default_rng(0)
    points = np.vstack([np.tile(rng.standard_normal(20), (300, 1)), rng.standard_normal((600, 20))])
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    index = ann.build(vectors, part_rows=64)
    got = ann.search(index, index.table.filter("vec_id % 100 = 0"), part_queries=3).toPandas()
    ids = np.arange(len(points))
    for own in range(0, 300, 100):
        found = got[got.query_id == own].sort_values("rank")
        assert list(zip(found.vec_id, found.score)) == brute(ids, points, own)
    hits = sum(len({v for v, _ in brute(ids, points, own)} & set(got[got.query_id == own].vec_id)) for own in range(0, 900, 100))
    assert hits >= 0.9 * 90


def test_no_vectors(spark):
    assert ann.build(spark.createDataFrame([], "vec_id long, embedding array<float>")) is None


def test_scan_abandons_only_by_the_test():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((3000, 64))
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    turned, ids = points @ turn, np.arange(3000)
    blocks = [np.ascontiguousarray(turned[:, a : a + 16]) for a in range(0, 64, 16)]
    hits = 0
    for i in range(50):
        at, distance = ann.scan(points[i], turned[i], points, blocks, ids, 11)
        want = np.sqrt(((points - points[i]) ** 2).sum(1))
        assert np.allclose(distance, want[at])
        hits += len(set(at) & set(np.argsort(want)[:11]))
    assert hits >= 0.97 * 550
