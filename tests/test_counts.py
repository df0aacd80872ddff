"""Count tests: the second method's own estimates, outliers, independent filtering, strata."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.dist import f_sf
from cohortloom.operators import counts, edger, filtering, nbtest


@pytest.fixture(scope="module")
def planted(spark):
    draw = np.random.default_rng(31)
    group, depth = np.arange(16) % 2, draw.uniform(0.6, 1.8, 16)
    table = np.empty((90, 16))
    for g in range(90):
        mean = draw.uniform(30, 300) * depth * 2 ** ((1.8 if g < 8 else 0.0) * group)
        table[g] = draw.negative_binomial(20, 20 / (20 + mean))
    rows = [(f"g{g:02d}", s, int(table[g, s])) for g in range(90) for s in range(16) if table[g, s]]
    design = spark.createDataFrame([(s, int(x)) for s, x in enumerate(group)], "sample int, grp int")
    return spark.createDataFrame(rows, "gene string, sample int, cnt bigint").cache(), design, table, group


# ------------------------------------------------------------ second method


def test_the_other_method_finds_the_effects(planted):
    df, design, _, _ = planted
    got = {r.gene: r for r in nbtest.nb_test(df, design, "grp", "edger").collect()}
    up, null = [got[f"g{g:02d}"] for g in range(8)], [got[f"g{g:02d}"] for g in range(8, 90)]
    assert np.median([r.log2fc for r in up]) == pytest.approx(1.8, abs=0.3) and sum(r.padj < 0.05 for r in up) == 8
    assert sum(r.padj < 0.05 for r in null) <= 4
    wald = {r.gene: r for r in nbtest.nb_test(df, design, "grp", "wald").collect()}
    assert any(abs(got[g].log2fc - wald[g].log2fc) > 1e-6 for g in got)  # neither factors nor dispersions are shared


def test_tagwise_dispersions_follow_the_plain_way(spark, planted):
    df, design, table, group = planted
    sizes = {r["sample"]: r.size_factor for r in edger.effective_sizes(df).collect()}
    genes = counts.pack_genes(df, design)
    genes = nbtest.replace(genes, size_factors=np.array([sizes[s] for s in genes.samples]))
    runs = nbtest.designs_of(genes, design.withColumn("run_id", F.lit(0)), ["grp"])
    common = edger.common_dispersions(genes, runs)
    got = {r.gene: r.dispersions[0] for r in edger.tagwise_dispersions(genes, runs).collect()}

    sf = np.array([sizes[s] for s in range(16)])
    x = np.column_stack([np.ones(16), group])
    grid = edger.adjusted_likelihoods(table, np.log(sf), x, common[0] * 2**edger.GRID)
    order = np.lexsort(([f"g{g:02d}" for g in range(90)], (table / sf).mean(axis=1)))
    half = int((10 / 90) ** 0.23 * 90) // 2
    near = np.empty_like(grid)
    for place, g in enumerate(order):
        near[g] = grid[order[max(0, place - half) : place + half + 1]].mean(axis=0)
    prior = 10 / 14
    values = (grid + prior * near) / (1 + prior)
    for g in range(90):
        best = int(values[g].argmax())
        want = edger.GRID[best]
        if 0 < best < 10:
            a, b, c = values[g, best - 1 : best + 2]
            want += 0.5 * (a - c) / (a - 2 * b + c) * 1.2
        assert got[f"g{g:02d}"] == pytest.approx(common[0] * 2**want, rel=1e-6)
    # The common dispersion is where the sum is highest: neighbours are lower.
    at = lambda d: edger.adjusted_likelihoods(table, np.log(sf), x, np.array([d])).sum()
    assert at(common[0]) > max(at(common[0] * 1.15), at(common[0] / 1.15))


def test_peak_is_that_of_a_parabola():
    points = np.linspace(-2, 2, 9)
    assert edger.peak(points, np.array([-((points - 0.3) ** 2), points, -points])) == pytest.approx([0.3, 2, -2])


# ----------------------------------------------------------------- outliers


def with_outlier(spark, table, group, gene, sample, value):
    changed = table.copy()
    changed[gene, sample] = value
    rows = [(f"g{g:02d}", s, int(changed[g, s])) for g in range(len(changed)) for s in range(changed.shape[1]) if changed[g, s]]
    return spark.createDataFrame(rows, "gene string, sample int, cnt bigint")


def test_planted_outlier_is_replaced(spark, planted):
    df, design, table, group = planted
    broken = with_outlier(spark, table, group, 40, 3, 60_000)
    found = {r.gene: r for r in nbtest.outliers(broken, design, "grp").collect()}
    assert found["g40"].n_replaced == 1 and not found["g40"].is_flagged
    assert sum(r.n_replaced for r in found.values()) <= 3
    factors = counts.size_factors(df)  # the same for both, so that only the gene itself can differ
    clean = {r.gene: r for r in nbtest.nb_test(df, design, "grp", factors=factors).collect()}
    after = {r.gene: r for r in nbtest.nb_test(broken, design, "grp", factors=factors).collect()}
    assert abs(after["g40"].log2fc) < 0.8 and after["g40"].pvalue > 0.01
    others = [g for g in clean if g != "g40"]
    assert np.median([abs(after[g].log2fc - clean[g].log2fc) for g in others]) < 1e-2


def test_small_groups_have_their_p_values_withheld(spark, planted):
    _, _, table, group = planted
    some = spark.createDataFrame([(s, int(group[s])) for s in range(10)], "sample int, grp int")  # five a group
    broken = with_outlier(spark, table, group, 50, 4, 80_000)
    found = {r.gene: r for r in nbtest.outliers(broken, some, "grp").collect()}
    assert found["g50"].is_flagged and found["g50"].n_replaced == 0 and found["g50"].max_cooks > nbtest.outlier_cut(10, 2)
    got = {r.gene: r for r in nbtest.nb_test(broken, some, "grp").collect()}
    assert got["g50"].pvalue is None and got["g50"].padj is None and got["g51"].pvalue is not None


def test_distances_are_those_of_leaving_a_count_in():
    """For a plain mean with equal weights the leverage is one over the samples, and distances follow by hand."""
    y = np.array([[10.0, 12, 11, 9, 30, 10]])
    x, mu, alpha = np.ones((6, 1)), np.full((1, 6), y.mean()), np.array([0.1])
    got = nbtest.cooks_distances(y, np.ones(6), x, mu, alpha, nbtest.Cells.in_design(x))
    gaps = np.sort((y[0] - np.sort(y[0])[1:5].mean()) ** 2)
    variance = 1.86 * gaps[1:5].mean()
    robust = max((variance - y.mean()) / y.mean() ** 2, 0.04)
    want = (y - y.mean()) ** 2 / (y.mean() + robust * y.mean() ** 2) * (1 / 6) / (5 / 6) ** 2
    assert got == pytest.approx(want, rel=1e-4)


def test_cut_is_the_quantile():
    for samples, coefficients in ((10, 2), (16, 2), (40, 4)):
        assert f_sf(np.array([nbtest.outlier_cut(samples, coefficients)]), coefficients, samples - coefficients)[0] == pytest.approx(0.01, rel=1e-6)


# ---------------------------------------------------------------- filtering


def plain_bh(p):
    order = np.argsort(p)
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


def test_adjusted_p_values_are_those_of_the_chosen_cut(spark):
    draw = np.random.default_rng(8)
    frames = []
    for run in ("a", "b"):
        base = np.where(draw.random(600) < 0.1, 0, draw.gamma(0.6, 60, 600).round(3))
        p = np.where((base > 60) & (draw.random(600) < 0.5), draw.random(600) * 1e-3, draw.random(600))
        frames.append(pd.DataFrame({"run_id": run, "gene": np.arange(600), "base": base, "p": p}))
    df = spark.createDataFrame(pd.concat(frames))
    got = filtering.filtered_fdr(df, "p", "base", ["run_id"], 0.1).toPandas()
    for frame in frames:
        base, p = frame.base.to_numpy(), frame.p.to_numpy()
        thetas = np.linspace((base == 0).mean(), 0.95, 50)
        cutoffs = np.quantile(base, thetas)
        rejected = np.array([(plain_bh(p[base >= c]) < 0.1).sum() for c in cutoffs])
        cut = cutoffs[filtering.chosen_cut(thetas, rejected)]
        want = np.full(600, np.nan)
        want[base >= cut] = plain_bh(p[base >= cut])
        mine = got[got.run_id == frame.run_id[0]].sort_values("gene").padj.to_numpy(float)
        assert np.allclose(mine, want, equal_nan=True) and cut > 0 and (want < 0.1).sum() > (plain_bh(p) < 0.1).sum()


def test_smoothing_keeps_lines_and_resists_one_point():
    x = np.linspace(0, 1, 50)
    assert filtering.smoothed(x, 3 * x + 1) == pytest.approx(3 * x + 1)
    y = 3 * x + 1 + np.random.default_rng(1).normal(size=50) * 0.1
    y[25] += 100
    off = np.abs(filtering.smoothed(x, y) - (3 * x + 1))
    plain = np.abs(filtering.smoothed(x, y, rounds=0) - (3 * x + 1))
    assert off[[21, 22, 23, 24, 28, 29]].max() < 0.6 and plain[[21, 22, 23, 24, 28, 29]].min() > 1.5


def test_few_rejections_choose_the_first_cut():
    assert filtering.chosen_cut(np.linspace(0, 0.95, 50), np.full(50, 7.0)) == 0
    assert filtering.chosen_cut(np.linspace(0, 0.95, 50), np.concatenate([np.linspace(20, 100, 25), np.full(25, 100.0)])) > 15


def test_no_rows(spark):
    empty = spark.createDataFrame([], "run_id string, p double, base double")
    assert filtering.filtered_fdr(empty, "p", "base", ["run_id"], 0.1).collect() == []


# ------------------------------------------------------------------- strata


def test_strata_end_on_one_level(spark):
    draw = np.random.default_rng(5)
    kind = np.arange(200) // 20
    rows = [(f"g{g:03d}", s, int(draw.poisson(20 * (1 + kind[g])))) for g in range(200) for s in range(3)]
    df = spark.createDataFrame([r for r in rows if r[2]], "gene string, sample int, cnt bigint")
    info = spark.createDataFrame([(f"g{g:03d}", float(kind[g])) for g in range(200)], "gene string, measure double")
    assert {r["stratum"]: r["count"] for r in counts.strata(info).groupBy("stratum").count().collect()} == dict.fromkeys(range(10), 20)
    got = counts.norm_counts(df, info).toPandas()
    got["kind"] = [kind[int(g[1:])] for g in got.gene]
    tops = got.groupby(["sample", "kind"]).value.quantile(0.75)
    assert tops.to_numpy() == pytest.approx(np.full(30, tops.iloc[0]))
