"""Time the headline queries, the median of up to three runs each, and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortloom.plans import catalog  # noqa: E402
from cohortloom.session import local_session  # noqa: E402

HEADLINE = [
    "select_best_subgroups", "filter_best_runs", "scan_variant_long", "matrix_wide_to_long", "scan_nested_json", "cohort_select",
    "mutation_matrix", "methylation_gene_matrix", "agg_region_counts", "filter_feature_by_null_ratio", "scale_standard", "join_knn",
    "impute_knn", "test_welch_t", "win_km_curve", "test_logrank", "cox_univariate_scan", "win_fdr_bh", "deg_consensus",
    "deseq_size_factors", "deseq_wald", "sva_batch", "score_anova_f", "score_mutual_info", "cluster_silhouette", "cluster_kmeans",
    "embed_autoencoder", "select_k_best", "drug_interactions", "structure_ids", "annotate_genes", "cv_repeated_stratified",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs, enough = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_ENOUGH", "10"))
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up is not measured: a query of each kind runs once before.
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    catalog.QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in HEADLINE:
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
            if sum(times) > enough:
                break  # the median of fewer runs is that of long queries
        seconds[key] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
