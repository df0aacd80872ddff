"""Autoencoders, classifiers, selection and count tests: gradients, known answers, planted signals."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import counts, embed, nbtest, select, sums, sva, svm


@pytest.mark.parametrize("settings", [{}, {"sparsity": 0.5}, {"loss": "bce"}])
def test_gradients_match_differences(settings):
    network = embed.Network(neurons=8, bottleneck=2, seed=3, **settings)
    draw = np.random.default_rng(1)
    x = draw.random((5, 6)) if settings.get("loss") != "bce" else (draw.random((5, 6)) > 0.5).astype(float)
    weights = embed._start(network, 6)
    for at in range(1, len(weights), 2):
        weights[at] = weights[at] + 0.3  # away from the corners of the rectifier
    grads, _ = embed._backward(network, weights, x, x)
    for at in (0, 6, 8, len(weights) - 2, len(weights) - 1):
        flat = weights[at].reshape(-1)
        keep = flat[0]
        values = []
        for move in (1e-6, -1e-6):
            flat[0] = keep + move
            values.append(embed._backward(network, weights, x, x)[1].sum())
        flat[0] = keep
        assert grads[at].reshape(-1)[0] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-3, abs=1e-6)


def vectors_of(spark, x, **columns):
    rows = [(i, [float(c) for c in v], *[columns[k][i] for k in columns]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["sample int", "vector array<double>", *[f"{k} int" for k in columns]]))


def test_training_lowers_the_loss_and_ignores_partitioning(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(80, 2)) @ draw.normal(size=(2, 6))
    df = vectors_of(spark, x)
    network = embed.Network(neurons=16, bottleneck=2, epochs=1, rate=0.02)
    first = embed.train(df, [network])[0].loss
    long = replace(network, epochs=40)
    one, two = embed.train(df, [long])[0], embed.train(df.repartition(5), [long])[0]
    assert one.loss < 0.5 * first
    assert two.loss == pytest.approx(one.loss, rel=1e-6)
    codes = embed.predict(df, one).collect()
    assert len(codes) == 80 and len(codes[0].vector) == 2
    assert {r.feature for r in embed.as_features(embed.predict(df, one)).collect()} == {"Feature1", "Feature2"}


def test_mini_batches_count_all_rows(spark):
    """The loss of an epoch and the held-out loss are over all rows that are the network's, whatever the batch."""
    draw = np.random.default_rng(6)
    df = vectors_of(spark, draw.normal(size=(90, 4))).withColumn("fold", F.pmod(F.xxhash64("sample"), F.lit(3)).cast("int"))
    sizes = {r.fold: r.n for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    still = [embed.Network(neurons=8, bottleneck=2, epochs=2, rate=0.0, fold=f) for f in range(3)]
    whole, parts = embed.train(df, still), embed.train(df, still, batch=16)
    assert [t.held_rows for t in parts] == [sizes[f] for f in range(3)]
    for a, b in zip(whole, parts):
        assert (a.loss, a.held_out) == (pytest.approx(b.loss), pytest.approx(b.held_out))
        rows = np.array([r.vector for r in df.where(F.col("fold") == b.network.fold).collect()])
        out = embed._forward(b.weights, rows)[-1]
        assert b.held_out == pytest.approx(np.mean((out - rows) ** 2))


def test_networks_train_alike_alone_and_together(spark, monkeypatch):
    df = vectors_of(spark, np.random.default_rng(8).normal(size=(60, 4)))
    networks = [
        embed.Network(neurons=8, bottleneck=2, epochs=4), embed.Network(neurons=8, bottleneck=2, epochs=4, noise_shift=0.5, noise_sigma=0.3),
        embed.Network(neurons=8, bottleneck=2, epochs=6, noise_sigma=1.0, seed=5),
    ]
    together = embed.train(df, networks, batch=20)
    monkeypatch.setattr(embed, "SHARED_WEIGHTS", 1)
    for one, alone in zip(together, embed.train(df, networks, batch=20)):
        assert one.loss == pytest.approx(alone.loss) and one.epochs == alone.network.epochs


def test_patience_is_each_networks_own(spark):
    df = vectors_of(spark, np.random.default_rng(9).normal(size=(40, 4)))
    networks = [embed.Network(neurons=8, bottleneck=2, epochs=12, rate=0.0), embed.Network(neurons=8, bottleneck=2, epochs=12, rate=0.01)]
    still, moving = embed.train(df, networks, patience=3)
    assert still.epochs == 4 and moving.epochs == 12


def test_default_networks_and_grid_points_can_be_trained(spark):
    df = vectors_of(spark, np.random.default_rng(10).normal(size=(12, 5)))
    trained = embed.train(df, [replace(n, epochs=1) for n in embed.VARIANTS.values()])
    assert all(np.isfinite(t.loss) and t.epochs == 1 for t in trained)
    points = [embed.Network(neurons=n, bottleneck=b, fold=f) for n in embed.GRID["neurons"] for b in embed.GRID["bottleneck"] for f in range(3)]
    assert sorted(i for g in embed._groups(points, 5) for i in g) == list(range(len(points)))
    assert np.isfinite(embed.grid_search(df, {"neurons": [3000], "bottleneck": [200], "batch": [32]}, epochs=1).head().held_out)


def test_saved_weights_encode_alike(spark, tmp_path):
    df = vectors_of(spark, np.random.default_rng(2).normal(size=(20, 4)))
    trained = embed.train(df, [embed.Network(neurons=8, bottleneck=2, epochs=2)])[0]
    embed.save(trained, spark, str(tmp_path / "model"))
    again = embed.load(spark, str(tmp_path / "model"), trained.network)
    a, b = [sorted((r.sample, tuple(r.vector)) for r in embed.predict(df, t).collect()) for t in (trained, again)]
    assert a == b


def test_grid_covers_every_point_and_orders_by_loss(spark):
    df = vectors_of(spark, np.random.default_rng(2).normal(size=(30, 4)))
    rows = embed.grid_search(df, {"neurons": [8, 12], "bottleneck": [1, 2], "batch": [16, 32]}, epochs=2).collect()
    assert len(rows) == 8 and [r.held_out for r in rows] == sorted(r.held_out for r in rows)


def test_noise_is_repeatable_with_the_right_moments(spark):
    df = spark.range(4000).selectExpr("id AS sample", "'f' AS feature", "0.0 AS value").withColumn("value", F.col("value").cast("double"))
    a = [r.value for r in embed.add_noise(df, 0.5, 0.3).orderBy("sample").collect()]
    b = [r.value for r in embed.add_noise(df.repartition(9), 0.5, 0.3).orderBy("sample").collect()]
    assert a == b and np.mean(a) == pytest.approx(0.5, abs=0.02) and np.std(a) == pytest.approx(0.3, abs=0.02)


def test_array_sums_over_many_tasks(spark, monkeypatch):
    df = spark.range(0, 100, 1, 10).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    partial = lambda b: np.stack(b["v"]).sum(axis=0)
    for small, fan in ((10**6, 512), (0, 512), (0, 3)):
        monkeypatch.setattr(sums, "SMALL", small)
        monkeypatch.setattr(sums, "FAN_IN", fan)
        assert list(sums.summed_array(df, partial, 2)) == [4950.0, 100.0]


def separable(spark):
    draw = np.random.default_rng(9)
    y = draw.integers(0, 2, 120)
    x = draw.normal(size=(120, 6))
    x[:, 2] += 3 * y
    x[:, 4] -= 2 * y
    rows = [(f"s{i:03d}", f"f{j}", float(x[i, j]), int(y[i])) for i in range(120) for j in range(6)]
    return spark.createDataFrame(rows, "sample string, feature string, value double, y int"), x, y


def test_shared_pass_classifiers_agree_with_the_library_one(spark):
    df, x, y = separable(spark)
    fold = np.arange(120) % 3
    rows = spark.createDataFrame([(float(a), [float(c) for c in v], [int(f)]) for a, v, f in zip(y, x, fold)], "label double, vector array<double>, folds array<int>")
    tasks = [svm.Task(0, f, tuple(range(6))) for f in range(3)]
    ours = svm.cross_validated(rows, 6, tasks)
    packed = select.pack(df, "y").rows
    for f in range(3):
        train, test = [packed.where((F.substring("sample", 2, 3).cast("int") % 3 == f) == held) for held in (False, True)]
        model = select.linear_svm(train)
        theirs = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).head()[0]
        assert ours[f] == pytest.approx(theirs, abs=0.051)


@pytest.mark.parametrize("method", ["anova", "mutual", "rf", "boosted"])
def test_selection_finds_the_planted_features(spark, method):
    df, _, _ = separable(spark)
    found = select.select_features(df, "y", method, folds=2, repeats=1, counts=[2, 4], trees=8)
    names = [r.feature for r in found.features.orderBy("rank").collect()]
    assert names[0] == "f2" and set(names[:2]) <= {"f2", "f4"} and found.score > 85
    assert method in ("rf", "boosted") or len(names) >= 2  # trees drop features below their mean importance


def test_candidate_counts():
    assert select.candidate_counts(64) == [64] and select.candidate_counts(100) == [100]
    assert select.candidate_counts(450) == [100, 200, 300, 400] and select.candidate_counts(1000) == list(range(100, 1001, 100))


def test_selection_refuses_missing_cells(spark):
    df, _, _ = separable(spark)
    with pytest.raises(Exception, match="impute"):
        select.pack(df.where("NOT (sample = 's001' AND feature = 'f0')"), "y").rows.collect()


@pytest.fixture(scope="module")
def planted(spark):
    draw = np.random.default_rng(21)
    group, batch = np.arange(16) % 2, np.arange(16) // 8
    depth = draw.uniform(0.5, 2, 16)
    rows = []
    for g in range(120):
        base = draw.uniform(20, 400)
        effect = 2.0 if g < 10 else (-1.5 if g < 20 else 0.0)
        hidden = (1.5 if g % 2 else -1.5) if 20 <= g < 70 else 0.0
        mean = base * depth * 2 ** (effect * group + hidden * batch)
        size = 1 / 0.05
        values = draw.negative_binomial(size, size / (size + mean))
        rows += [(f"g{g:03d}", s, int(c)) for s, c in enumerate(values) if c]
    counts_ = spark.createDataFrame(rows, "gene string, sample int, cnt bigint")
    design = spark.createDataFrame([(s, int(g)) for s, g in enumerate(group)], "sample int, grp int")
    return counts_, design, depth, batch


def test_size_factors_follow_depth(spark, planted):
    table, _, depth, _ = planted
    got = {r.sample: r.size_factor for r in counts.size_factors(table).collect()}
    ratio = np.array([got[s] for s in range(16)]) / depth
    assert ratio.std() / ratio.mean() < 0.25


@pytest.mark.parametrize("method", ["wald", "lrt"])
def test_planted_effects_are_found(planted, method):
    table, design, _, _ = planted
    got = {r.gene: r for r in nbtest.nb_test(table, design, "grp", method).collect()}
    up = [got[f"g{g:03d}"] for g in range(10)]
    down = [got[f"g{g:03d}"] for g in range(10, 20)]
    null = [got[f"g{g:03d}"] for g in range(70, 120)]
    assert np.median([r.log2fc for r in up]) == pytest.approx(2.0, abs=0.4)
    assert np.median([r.log2fc for r in down]) == pytest.approx(-1.5, abs=0.4)
    assert sum(r.padj < 0.05 for r in up + down) >= 18
    assert sum(r.padj < 0.05 for r in null) <= 5
    assert all(r.padj >= r.pvalue - 1e-12 for r in got.values())


def test_swapped_groups_turn_the_sign(planted):
    table, design, _, _ = planted
    designs = design.withColumn("run_id", F.lit("a")).union(design.selectExpr("sample", "1 - grp", "'b'"))
    rows = nbtest.nb_test_runs(table, designs, "grp").collect()
    one, two = [{r.gene: r for r in rows if r.run_id == name} for name in "ab"]
    for gene in one:
        assert one[gene].log2fc == pytest.approx(-two[gene].log2fc, abs=1e-3)
        assert one[gene].pvalue == pytest.approx(two[gene].pvalue, abs=1e-3)


def test_hidden_batch_is_found(planted):
    table, design, _, batch = planted
    got = {r.sample: r.sv1 for r in sva.hidden_covariates(table, design, "grp", 2).collect()}
    assert abs(np.corrcoef([got[s] for s in range(16)], batch)[0, 1]) > 0.9


def test_leading_directions_are_those_of_the_whole_product(spark):
    draw = np.random.default_rng(12)
    data = draw.normal(size=(90, 25)) * np.linspace(3, 0.5, 25)
    rows = spark.createDataFrame([(r.tolist(),) for r in data], "v array<double>").repartition(3)
    found = sva._leading(rows, lambda b: np.stack(b["v"]), 25, 3)
    want = np.linalg.svd(data)[2][:3].T
    assert np.abs((found * want).sum(axis=0)) == pytest.approx(np.ones(3), abs=1e-6)
    assert (found[np.abs(found).argmax(axis=0), np.arange(3)] > 0).all()
    assert sva._leading(rows.limit(0), lambda b: np.stack(b["v"]), 25, 3) is None


def test_hidden_batch_of_many_samples(spark):
    """4,500 samples: their product with each other would not fit, the directions do."""
    draw = np.random.default_rng(13)
    size, genes = 4500, 40
    batch = draw.integers(0, 2, size)
    effect = np.where(np.arange(genes) % 2, draw.normal(size=genes), 0.0)  # every other gene is left alone
    means = 200 * np.exp(np.outer(effect, batch) + draw.normal(size=(genes, size)) * 0.1)
    table = spark.createDataFrame(
        pd.DataFrame({"gene": np.repeat([f"g{i:02d}" for i in range(genes)], size), "sample": np.tile(np.arange(size), genes), "cnt": draw.poisson(means).ravel()})
    ).selectExpr("gene", "sample", "cast(cnt as long) AS cnt")
    design = spark.createDataFrame(pd.DataFrame({"sample": np.arange(size), "grp": draw.integers(0, 2, size)}))
    got = sva.hidden_covariates(table, design, "grp", 1, rounds=1).toPandas().sort_values("sample")
    assert abs(np.corrcoef(got.sv1, batch)[0, 1]) > 0.9


def test_one_schema_over_methods(planted):
    table, design, _, _ = planted
    both = nbtest.run_tests(table, design.withColumn("run_id", F.lit("r")), "grp", "all", batch_removal=True)
    assert both.columns == ["run_id", *nbtest.RESULT, "method"]
    assert {(r.method, r["count"]) for r in both.groupBy("method").count().collect()} == {("edger", 120), ("deseq2", 120)}


def test_normalized_quartiles_are_equal(planted):
    table, _, _, _ = planted
    scaled = counts.norm_counts(table)
    tops = [np.quantile([r.value for r in scaled.where(F.col("sample") == s).collect()], 0.75) for s in (0, 5, 11)]
    assert tops == pytest.approx([tops[0]] * 3)
