"""Queries over the score history."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.plans import analysis
from cohortloom.plans.registry import query
from cohortloom.plans.views import view, with_views

_NAMES = ["silhouette", *[n for pair in analysis.F1_PAIRS for n in pair]]

_LIMITS = "limits AS (SELECT " + ", ".join(
    f"quantile_cont({n}, {0.5 if n == 'silhouette' else 0.7}) AS q_{n}" for n in _NAMES
) + " FROM fx_scores)"

_PASSES = """silhouette >= q_silhouette AND log_rank_p < 0.05 AND tmb_p < 0.05
    AND (rna_anova >= q_rna_anova OR rna_rf >= q_rna_rf) AND (mirna_anova >= q_mirna_anova OR mirna_rf >= q_mirna_rf)
    AND (meth_anova >= q_meth_anova OR meth_rf >= q_meth_rf)"""


@query(
    "select_best_subgroups",
    with_views(
        "fx_scores",
        f"+{_LIMITS}, best AS (SELECT fx_scores.* FROM fx_scores, limits WHERE {_PASSES} "
        "ORDER BY md5(CAST(run_id AS VARCHAR) || '-331'), run_id LIMIT 100) "
        "SELECT * FROM best ORDER BY silhouette DESC, run_id",
    ),
)
def select_best_subgroups(spark, sf_dir):
    return analysis.select_best_subgroups(view(spark, sf_dir, "fx_scores"))


@query("filter_best_runs", with_views("fx_scores", f"+{_LIMITS} SELECT fx_scores.* FROM fx_scores, limits WHERE {_PASSES}"))
def filter_best_runs(spark, sf_dir):
    return analysis.filter_best_runs(view(spark, sf_dir, "fx_scores"))


@query(
    "agg_quantiles",
    with_views("fx_scores", f"+{_LIMITS} SELECT " + ", ".join(f"ROUND(q_{n}, 6) AS q_{n}" for n in _NAMES) + " FROM limits"),
)
def agg_quantiles(spark, sf_dir):
    limits = analysis.score_thresholds(view(spark, sf_dir, "fx_scores"))
    return limits.select(*[F.round(f"q_{n}", 6).alias(f"q_{n}") for n in _NAMES])


@query(
    "sample_k_seeded",
    with_views("fx_scores", "SELECT run_id, silhouette FROM fx_scores ORDER BY md5(CAST(run_id AS VARCHAR) || '-331'), run_id LIMIT 100"),
)
def sample_k_seeded(spark, sf_dir):
    return analysis.sample_k_seeded(view(spark, sf_dir, "fx_scores").select("run_id", "silhouette"), "run_id", 100, 331)


@query("sort_desc_score", with_views("fx_scores", "SELECT run_id, silhouette FROM fx_scores ORDER BY silhouette DESC, run_id"))
def sort_desc_score(spark, sf_dir):
    return view(spark, sf_dir, "fx_scores").select("run_id", "silhouette").orderBy(F.desc("silhouette"), "run_id")
