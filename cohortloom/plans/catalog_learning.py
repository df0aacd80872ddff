"""Queries for imputation, clustering, embeddings and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import cluster, embed, impute, select
from cohortloom.plans.registry import query
from cohortloom.plans.views import view, with_views
from cohortloom.runtime import scratch_path

_PAIRS = """+w AS (SELECT COUNT(DISTINCT feature) AS width FROM fx_matrix),
    d AS (SELECT a.sample AS sample, b.sample AS neighbour, SQRT((SELECT width FROM w) * SUM(POWER(a.value - b.value, 2)) / COUNT(*)) AS distance
      FROM fx_matrix a JOIN fx_matrix b ON a.feature = b.feature AND a.sample <> b.sample GROUP BY 1, 2) """


@query("join_knn", with_views("fx_matrix", _PAIRS + "SELECT sample, neighbour, ROUND(distance, 6) AS distance, "
       "(ROW_NUMBER() OVER (PARTITION BY sample ORDER BY distance, neighbour))::INTEGER AS rank FROM d QUALIFY rank <= 5"))
def join_knn(spark, sf_dir):
    return impute.nearest_samples(view(spark, sf_dir, "fx_matrix"), 5).withColumn("distance", F.round("distance", 6))


@query("impute_knn", with_views("fx_matrix", _PAIRS.rstrip() + """, cells AS (SELECT s.sample, f.feature FROM (SELECT DISTINCT sample FROM fx_matrix) s, (SELECT DISTINCT feature FROM fx_matrix) f),
    missing AS (SELECT * FROM cells ANTI JOIN fx_matrix USING (sample, feature)),
    near AS (SELECT m.sample, m.feature, v.value FROM missing m JOIN d ON d.sample = m.sample JOIN fx_matrix v ON v.sample = d.neighbour AND v.feature = m.feature
      QUALIFY ROW_NUMBER() OVER (PARTITION BY m.sample, m.feature ORDER BY distance, neighbour) <= 5)
    SELECT sample, feature, ROUND(AVG(value), 6) AS value FROM near GROUP BY 1, 2 UNION ALL SELECT sample, feature, value FROM fx_matrix"""))
def impute_knn(spark, sf_dir):
    return impute.impute_knn(view(spark, sf_dir, "fx_matrix"), 5).withColumn("value", F.round("value", 6))


def cell_vectors(spark, sf_dir):
    """The labelled vectors as doubles."""
    return view(spark, sf_dir, "fx_cells").select("sample", "label", "grp", F.col("embedding").cast("array<double>").alias("vector"))


_DIST = """+v AS (SELECT sample, label, embedding::DOUBLE[] AS e FROM fx_cells),
    d AS (SELECT a.sample, a.label AS la, b.label AS lb, SQRT(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
      FROM v a JOIN v b ON a.sample <> b.sample) """
_SIL = _DIST.rstrip() + """, m AS (SELECT sample, la, lb, SUM(dist) AS t FROM d GROUP BY 1, 2, 3), z AS (SELECT label, COUNT(*) AS n FROM v GROUP BY 1),
    s AS (SELECT sample, MAX(CASE WHEN la = lb THEN t / NULLIF(n - 1, 0) END) AS a, MIN(CASE WHEN la <> lb THEN t / n END) AS b FROM m JOIN z ON z.label = m.lb GROUP BY 1) """


@query("cluster_silhouette", with_views("fx_cells", _SIL + "SELECT ROUND(AVG(COALESCE((b - a) / GREATEST(a, b), 0)), 6) AS silhouette FROM s"))
def cluster_silhouette(spark, sf_dir):
    """Exact silhouette of the given labels."""
    score = cluster.silhouette_mean(cell_vectors(spark, sf_dir), "label")
    return score.select(F.round("silhouette", 6).alias("silhouette"))


@query("cluster_c_index", with_views("fx_cells", _DIST.replace("a.sample <> b.sample", "a.sample < b.sample").rstrip() + """, w AS (SELECT COUNT(*) AS n, SUM(dist) AS s FROM d WHERE la = lb),
    r AS (SELECT dist, ROW_NUMBER() OVER (ORDER BY dist) AS up, ROW_NUMBER() OVER (ORDER BY dist DESC) AS down FROM d)
    SELECT ROUND(((SELECT s FROM w) - SUM(dist) FILTER (up <= (SELECT n FROM w))) / (SUM(dist) FILTER (down <= (SELECT n FROM w)) - SUM(dist) FILTER (up <= (SELECT n FROM w))), 6) AS c_index FROM r"""))
def cluster_c_index(spark, sf_dir):
    """C-index of the given labels."""
    return cluster.cluster_indices(cell_vectors(spark, sf_dir), ["label"]).select(F.round("c_index", 6).alias("c_index"))


@query("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    return cluster.kmeans(cell_vectors(spark, sf_dir), 2)


@query("cluster_kmeans_step", with_views("fx_cells", """+v AS (SELECT sample, label, embedding::DOUBLE[] AS e FROM fx_cells),
    c AS (SELECT label, i, AVG(e[i]) AS x FROM v, range(1, 65) AS t(i) GROUP BY 1, 2), k AS (SELECT label, list(x ORDER BY i) AS x FROM c WHERE label < 2 GROUP BY 1),
    n AS (SELECT v.sample, v.e, arg_min(k.label, list_sum(list_transform(list_zip(v.e, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS g FROM v, k GROUP BY 1, 2)
    SELECT g AS "group", (i - 1)::INTEGER AS at, COUNT(*) AS n, ROUND(AVG(e[i]), 6) + 0.0 AS center FROM n, range(1, 65) AS t(i) GROUP BY 1, 2"""))
def cluster_kmeans_step(spark, sf_dir):
    """One Lloyd step over all samples from the centres of labels 0 and 1."""
    vectors = cell_vectors(spark, sf_dir)
    means = (
        vectors.where("label < 2").select("label", F.posexplode("vector").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    )
    packed = means.groupBy(F.col("label").alias("group")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("cells"))
    centers = packed.select("group", F.col("cells.x").alias("vector"))
    return cluster.lloyd_step(vectors, centers).withColumn("center", F.round("center", 6) + F.lit(0.0))


@query("cluster_index_sweep")
def cluster_index_sweep(spark, sf_dir):
    return cluster.index_sweep(cell_vectors(spark, sf_dir))


# ------------------------------------------------------------------ embeddings

NETWORK = embed.Network()


@query("embed_autoencoder")
def embed_autoencoder(spark, sf_dir):
    """Train one network on all vectors; one row with its size and reconstruction loss."""
    trained = embed.train(cell_vectors(spark, sf_dir), [NETWORK])[0]
    rows = [(trained.inputs, trained.network.bottleneck, sum(w.size for w in trained.weights), trained.loss)]
    return spark.createDataFrame(rows, "inputs int, bottleneck int, weights int, loss double")


@query("embed_predict")
def embed_predict(spark, sf_dir):
    vectors = cell_vectors(spark, sf_dir)
    codes = embed.predict(vectors, embed.train(vectors, [NETWORK])[0])
    return codes.select("sample", *[F.get("vector", i).alias(f"Feature{i + 1}") for i in range(NETWORK.bottleneck)])


@query("embed_variants")
def embed_variants(spark, sf_dir):
    """The plain, sparse and denoising network, trained in the same passes."""
    trained = embed.train(cell_vectors(spark, sf_dir), list(embed.VARIANTS.values()))
    return spark.createDataFrame([(name, t.loss) for name, t in zip(embed.VARIANTS, trained)], "variant string, loss double")


@query("add_noise")
def add_noise(spark, sf_dir):
    return embed.add_noise(view(spark, sf_dir, "fx_matrix"))


@query("grid_search_embed")
def grid_search_embed(spark, sf_dir):
    return embed.grid_search(cell_vectors(spark, sf_dir))


@query("sink_model")
def sink_model(spark, sf_dir):
    """Save a trained network, load it again, encode with the loaded one."""
    vectors = cell_vectors(spark, sf_dir)
    trained = embed.train(vectors, [NETWORK])[0]
    path = scratch_path(spark, "model")
    embed.save(trained, spark, path)
    return embed.as_features(embed.predict(vectors, embed.load(spark, path, trained.network)))


# ----------------------------------------------------------- feature selection


def labelled_cells(spark, sf_dir):
    """The labelled vectors in long form with their two-class label."""
    rows = view(spark, sf_dir, "fx_cells").select("sample", "grp", F.posexplode("embedding").alias("at", "value"))
    return rows.select("sample", "grp", F.concat(F.lit("Feature"), F.col("at") + 1).alias("feature"), F.col("value").cast("double").alias("value"))


#: The vectors are narrower than the operator's steps of 100, which would leave one number, all 64, to choose from.
COUNTS = [16, 32, 48, 64]


def _summary(spark, selection, method):
    """Selected features with the number chosen and the cross-validated score."""
    return selection.features.select(
        F.lit(method).alias("method"), "feature", "rank", F.round("score", 9).alias("score"),
        F.lit(selection.count).alias("n_selected"), F.round(F.lit(selection.score), 6).alias("f1"),
    )


@query("select_k_best")
def select_k_best(spark, sf_dir):
    found = select.select_features(labelled_cells(spark, sf_dir), "grp", "anova", folds=10, counts=COUNTS)
    return _summary(spark, found, "anova")


@query("select_rf_importance")
def select_rf_importance(spark, sf_dir):
    found = select.select_features(labelled_cells(spark, sf_dir), "grp", "rf", folds=5, counts=COUNTS)
    return _summary(spark, found, "rf")


@query("select_boosted_importance")
def select_boosted_importance(spark, sf_dir):
    found = select.select_features(labelled_cells(spark, sf_dir), "grp", "boosted", folds=5, counts=COUNTS)
    return _summary(spark, found, "boosted")


@query("classify_linear_svm")
def classify_linear_svm(spark, sf_dir):
    """Fit on all vectors; predicted and true class of each."""
    packed = select.pack(labelled_cells(spark, sf_dir), "grp")
    return select.linear_svm(packed.rows).transform(packed.rows).select("sample", "label", "prediction")


@query("feature_selection_run")
def feature_selection_run(spark, sf_dir):
    """ANOVA and forest selection of three data types: thirds of the vector's positions stand for them."""
    cells = labelled_cells(spark, sf_dir).withColumn("type", F.regexp_extract("feature", "[0-9]+", 0).cast("int") % 3)
    types = {name: cells.where(F.col("type") == at).drop("type") for at, name in enumerate(("rna", "mirna", "mt"))}
    found = select.select_for_types(types, "grp", common={"counts": [8, 16, 21]})
    rows = [(name, method, s.count, round(s.score, 6)) for (name, method), s in found.items()]
    return spark.createDataFrame(rows, "data_type string, method string, n_selected int, f1 double")
