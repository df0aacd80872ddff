"""Tests and scores per feature, adjusted p-values, consensus."""

import math

import numpy as np
import pytest

from cohortloom.operators import diffexp, ordered, sampling, stats


@pytest.fixture(scope="module")
def cells(spark):
    draw = np.random.default_rng(11)
    y = np.array([0] * 25 + [1] * 35)
    x = {"near": draw.normal(size=60) + y * 2, "noise": draw.normal(size=60), "ties": draw.integers(0, 4, 60).astype(float), "flat": np.ones(60)}
    rows = [(i, f, float(v), int(y[i])) for f, vs in x.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "sample int, feature string, value double, y int"), x, y


def brute_f(x, y):
    groups = [x[y == g] for g in np.unique(y)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - len(groups))
    return between / within


def test_anova(cells):
    df, x, y = cells
    got = {r.feature: r for r in stats.anova_f(df, "y").collect()}
    assert got["flat"].f is None and got["flat"].p is None
    for name in ("near", "noise", "ties"):
        assert got[name].f == pytest.approx(brute_f(x[name], y))
    assert got["near"].p < 1e-6


def test_anova_outside_each_fold(cells):
    df, x, y = cells
    dealt = sampling.repeated_stratified_folds(df.select("sample", "y").distinct(), "sample", "y", 3, 2, 1)
    fold = {(r.sample, r.repeat): r.fold for r in dealt.collect()}
    for r in stats.anova_f_without_fold(df, "y", dealt, 3).where("feature <> 'flat'").collect():
        keep = np.array([fold[i, r.repeat] != r.held for i in range(60)])
        assert r.f == pytest.approx(brute_f(x[r.feature][keep], y[keep]))


def brute_mi(x, y, neighbours=3):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    n, parts = len(x), []
    for i in range(n):
        same = np.sort(np.abs(x[(y == y[i]) & (np.arange(n) != i)] - x[i]))
        k = min(neighbours, len(same))
        d = same[k - 1]
        m = np.sum(np.abs(x - x[i]) < d) if d > 0 else np.sum(x == x[i])
        parts.append(psi(k) - psi((y == y[i]).sum()) - psi(m))
    return max(0.0, psi(n) + np.mean(parts))


def test_mutual_information_with_ties(cells):
    df, x, y = cells
    got = {r.feature: r.mi for r in stats.mutual_information(df, "y").collect()}
    for name in ("near", "noise", "ties"):
        assert got[name] == pytest.approx(brute_mi(x[name], y), abs=1e-9)


def test_welch(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 4.0)] + [(1, v) for v in (3.0, 7.0, 8.0, None)], "g int, v double")
    row = stats.welch_t(df, "v", "g").head()
    a, b = np.array([1, 2, 4.0]), np.array([3, 7, 8.0])
    ea, eb = a.var(ddof=1) / 3, b.var(ddof=1) / 3
    assert row.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(ea + eb))
    assert row.df == pytest.approx((ea + eb) ** 2 / (ea**2 / 2 + eb**2 / 2))
    alone = stats.welch_t(df.where("NOT (g = 0 AND v > 1)"), "v", "g").head()
    assert alone.t is None and alone.p is None


def test_scaling(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 3.0), ("a", "c", 5.0), ("b", "c", 5.0)], "sample string, feature string, value double")
    assert {tuple(r) for r in stats.scale_standard(df).collect()} == {("a", "f", -1.0), ("b", "f", 1.0), ("a", "c", 0.0), ("b", "c", 0.0)}
    assert {tuple(r) for r in stats.scale_minmax(df).collect()} == {("a", "f", 0.0), ("b", "f", 1.0), ("a", "c", 0.0), ("b", "c", 0.0)}


@pytest.mark.parametrize("limit", [ordered.ROWS_PER_WINDOW, 25])
def test_adjusted_p(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "ROWS_PER_WINDOW", limit)
    draw = np.random.default_rng(6)
    p = np.round(draw.random(120), 2)
    p[:3] = 0.0
    df = spark.createDataFrame([(i % 2, i, float(v)) for i, v in enumerate(p)] + [(0, 999, None)], "run int, id int, p double")
    got = {r.id: r.padj for r in diffexp.fdr_bh(df, "p", ["run"]).collect()}
    assert got[999] is None and len(got) == 121
    for run in (0, 1):
        ids = [i for i in range(120) if i % 2 == run]
        order = sorted(ids, key=lambda i: p[i])
        best = 1.0
        for rank in range(len(order), 0, -1):
            best = min(best, p[order[rank - 1]] * len(order) / rank)
            assert got[order[rank - 1]] == pytest.approx(best)


def test_volcano_is_strict_and_null_is_not_significant(spark):
    df = spark.createDataFrame([(1.6, 0.01), (1.5, 0.05), (-2.0, None), (0.1, 0.01)], "log2fc double, padj double")
    assert [r.volcano for r in diffexp.volcano_class(df).collect()] == ["FC and P", "NS", "FC", "P"]


def test_consensus_counts_runs_without_the_gene(spark):
    df = spark.createDataFrame([(0, "g", 1.0), (1, "g", 3.0), (3, "h", -2.0)], "run_id int, gene string, log2fc double")
    got = {r.gene: tuple(r)[1:] for r in diffexp.consensus(df, 4).collect()}
    assert got == {"g": (50.0, 2.0, 2.0), "h": (25.0, -2.0, -2.0)}
    wide = diffexp.wide_by_run(df, [0, 1, 2, 3], {"log2FoldChange": "log2fc"}).orderBy("gene")
    assert wide.columns == ["gene"] + [f"SubGroup-{r}_log2FoldChange" for r in range(4)]
    assert tuple(wide.head()) == ("g", 1.0, 3.0, None, None)


def test_rmsle_and_f1(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    assert stats.rmsle(df, "y", "p").head()[0] == pytest.approx(math.sqrt((math.log(3) - math.log(2)) ** 2 / 2))
    assert stats.f1_micro(df, "y", "p").head()[0] == 50.0


def test_key_alignment(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "k string")
    assert tuple(stats.key_alignment(a, b, "k").head()) == (1, 1, 1)


def test_burden(spark):
    rows = [("TCGA-A-B-01A-1-1-1", "Silent")] + [("TCGA-A-B-01A-1-1-1", "Splice_Site")] * 38 + [("TCGA-A-C-01B-1-1-1", "Splice_Site")]
    df = spark.createDataFrame(rows, "tumor_sample_barcode string, variant_classification string")
    assert [tuple(r) for r in stats.tmb_per_sample(df).collect()] == [("TCGA-A-B-01", 38, 1.0, 1.0)]
