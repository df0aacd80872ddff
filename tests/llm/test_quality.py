"""The ordinal classifier: gradient, order of thresholds, held-out accuracy."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cohortloom.llm import catalog, quality

from .conftest import awkward_rows


def test_features_of_awkward_texts():
    texts = [r[1] for r in awkward_rows()]
    row, feature, value = quality.features(pa.array(texts, pa.string()))
    assert (np.diff(row) >= 0).all() and feature.max() < 1 << quality.BITS and (value > 0).all()
    for i, t in enumerate(texts):
        alone = quality.features(pa.array([t], pa.string()))
        together = sorted(zip(feature[row == i].tolist(), value[row == i].tolist()))
        assert together == sorted(zip(alone[1].tolist(), alone[2].tolist()))


def made(n, seed):
    rng = np.random.default_rng(seed)
    marks = [["scum", "idiot"], ["meh%%%", "so***"], ["fine", "well"]]
    grade = rng.integers(0, 3, n)
    texts = [" ".join([f"w{rng.integers(300)}" for _ in range(40)] + [marks[g][rng.integers(2)] for _ in range(3)]) for g in grade]
    return grade, texts


def test_held_out_accuracy_and_expected_grades():
    grade, texts = made(600, 0)
    model = quality.fit_rows(grade, *quality.features(pa.array(texts)), 3)
    assert (np.diff(model.thresholds) > 0).all()
    grade, texts = made(400, 1)
    tails = model.tails(pa.array(texts))
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert ((tails[:, -1] >= 0.5) == (grade == 2)).mean() > 0.97
    means = [tails.sum(1)[grade == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def test_the_fit_is_at_its_best():
    grade, texts = made(300, 2)
    row, feature, value = quality.features(pa.array(texts))
    model = quality.fit_rows(grade, row, feature, value, 3, penalty=1e-2)

    def loss(weights, thresholds):
        score = np.bincount(row, weights=weights[feature] * value, minlength=len(grade))
        p = np.hstack([np.ones((len(grade), 1)), 1 / (1 + np.exp(-(score[:, None] - thresholds[None]))), np.zeros((len(grade), 1))])
        return -np.log(p[np.arange(len(grade)), grade] - p[np.arange(len(grade)), grade + 1]).mean() + 0.005 * (weights**2).sum()

    at = loss(model.weights, model.thresholds)
    rng = np.random.default_rng(0)
    for _ in range(10):
        step = np.zeros_like(model.weights)
        step[np.unique(feature)] = rng.normal(size=len(np.unique(feature)))
        assert loss(model.weights + 3e-2 * step, model.thresholds + 3e-2 * rng.normal(size=2)) > at - 1e-6


def test_the_fit_works_in_pieces(monkeypatch):
    grade, texts = made(300, 3)
    row, feature, value = quality.features(pa.array([*texts, "", *texts[:5], ""]))
    grade = np.concatenate([grade, [1], grade[:5], [2]])
    whole = quality.fit_rows(grade, row, feature, value, 3)
    for most in (1, 50, 4000):
        monkeypatch.setattr(quality, "ENTRIES_AT_ONCE", most)
        parted = quality.fit_rows(grade, row, feature, value, 3)
        assert np.array_equal(parted.weights, whole.weights) and np.array_equal(parted.thresholds, whole.thresholds)


def test_the_memory_of_the_fit():
    n, each = 10_000, 400
    rng = np.random.default_rng(4)
    made_of = [np.repeat(np.arange(n, dtype=np.int32), each), rng.integers(0, 1 << quality.BITS, n * each).astype(np.int32), np.ones(n * each, np.float32)]
    grade = rng.integers(0, 3, n)
    tracemalloc.start()
    try:
        quality.fit_rows(grade, *made_of, 3, rounds=1)
        assert tracemalloc.get_traced_memory()[1] < 22 * n * each
    finally:
        tracemalloc.stop()


def ratings(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark, awkward):
    labels = ratings(spark, [(6, 1, 0), (7, 1, 0), (8, 0, 0), (8, 1, 0), (10, 1, 1), (None, 0, 1), (11, None, 0), (12, 0, None), (99, 1, 0)])
    grades = {r.doc_id: r.grade for r in quality.grades_of(labels.filter("doc_id > 8 OR doc_id = 7")).collect()}
    assert grades == {7: 2, 10: 0, 11: None, 12: 1, 99: 2}
    model = quality.fit(awkward, quality.grades_of(labels), 3)
    scored = quality.score(awkward, model).collect()
    assert len(scored) == len(awkward_rows()) and all(0 <= s.tail_probability <= 1 and 0 <= s.expected_grade <= 2 for s in scored)
    kept = quality.select(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(s.kept for s in scored)


def test_without_ratings_nothing_is_rejected(spark, awkward, nothing):
    model = quality.fit(awkward, quality.grades_of(ratings(spark, [])), 3)
    assert all(s.kept for s in quality.score(awkward, model).collect())
    assert quality.score(nothing, model).count() == 0


def test_given_labels(spark):
    """Fitted on the ratings of the given tables' even ids, judged on the odd ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, quality.grades_of(labels.filter("doc_id % 2 = 0")), 3)
    odd = quality.grades_of(labels.filter("doc_id % 2 = 1")).join(quality.score(docs, model), "doc_id").toPandas()
    assert odd.kept[odd.grade == 2].mean() > 0.99
    assert odd.kept[odd.grade == 0].mean() < 0.25 and odd.kept[odd.grade == 1].mean() < 0.06


def test_query(spark, small):
    got = catalog.QUERIES["op9_quality_classifier"](spark, small)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
