"""Queries for projections, filters, joins, aggregates, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalar
from cohortloom.operators import diffexp, lists, matrix, ordered, relational, sampling
from cohortloom.plans.registry import query
from cohortloom.plans.views import orders_view, table, view, with_views
from cohortloom.runtime import partitions_for, union_all

# ---------------------------------------------------------------- projections


@query("project_columns", with_views("fx_deg", "SELECT gene, log2fc, pvalue FROM fx_deg"))
def project_columns(spark, sf_dir):
    return view(spark, sf_dir, "fx_deg").select("gene", "log2fc", "pvalue")


@query("project_reorder", with_views("fx_variants", "SELECT hugo_symbol, tumor_sample_barcode, variant_classification FROM fx_variants"))
def project_reorder(spark, sf_dir):
    df = view(spark, sf_dir, "fx_variants")
    return df.select("hugo_symbol", *[c for c in df.columns if c != "hugo_symbol"])


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_totalprice", "o_orderdate", "o_orderpriority")


@query("rename_columns", with_views("fx_deg", 'SELECT gene, log2fc AS "NT-TP_Log2FC", pvalue AS nt_tp_pvalue FROM fx_deg'))
def rename_columns(spark, sf_dir):
    df = view(spark, sf_dir, "fx_deg").select("gene", "log2fc", "pvalue")
    return df.withColumnsRenamed({"log2fc": "NT-TP_Log2FC", "pvalue": "nt_tp_pvalue"})


@query("prefix_columns", with_views("fx_matrix6", "SELECT modality, sample, modality || '.' || feature AS feature, value FROM fx_matrix6"))
def prefix_columns(spark, sf_dir):
    return matrix.prefixed(view(spark, sf_dir, "fx_matrix6"), F.concat("modality", F.lit(".")))


@query("suffix_columns", with_views("fx_matrix", "SELECT sample, feature || '_RNA' AS feature, value FROM fx_matrix"))
def suffix_columns(spark, sf_dir):
    return matrix.suffixed(view(spark, sf_dir, "fx_matrix"), "_RNA")


_RUN_COLUMNS = ", ".join(
    f"MAX(CASE WHEN run_id = {r} THEN log2fc END) AS \"SubGroup-{r}_log2FoldChange\", "
    f"MAX(CASE WHEN run_id = {r} THEN pvalue END) AS \"SubGroup-{r}_pvalue\""
    for r in range(10)
)


@query("rename_by_run", with_views("fx_deg", f"SELECT gene, {_RUN_COLUMNS} FROM fx_deg GROUP BY gene"))
def rename_by_run(spark, sf_dir):
    return diffexp.wide_by_run(view(spark, sf_dir, "fx_deg"), list(range(10)), {"log2FoldChange": "log2fc", "pvalue": "pvalue"})


@query(
    "select_columns_by_pattern",
    with_views("fx_deg", "SELECT gene, " + ", ".join(
        f"MAX(CASE WHEN run_id = {r} THEN log2fc END) AS \"SubGroup-{r}_log2FoldChange\"" for r in range(10)
    ) + " FROM fx_deg GROUP BY gene"),
)
def select_columns_by_pattern(spark, sf_dir):
    wide = rename_by_run(spark, sf_dir)
    return wide.select("gene", wide.colRegex("`.*[0-9]_log2FoldChange.*`"))


@query("exclude_column", with_views("fx_counts", "SELECT sample, gene, cnt FROM fx_counts"))
def exclude_column(spark, sf_dir):
    return view(spark, sf_dir, "fx_counts").drop("grp")


@query("positional_slice", with_views("fx_survival", "SELECT sample, os, os_time FROM fx_survival"))
def positional_slice(spark, sf_dir):
    df = view(spark, sf_dir, "fx_survival")
    return df.select(df.columns[:3])


@query("set_reset_index", with_views("fx_survival", "SELECT grp AS \"group\", sample, os FROM fx_survival"))
def set_reset_index(spark, sf_dir):
    """The key stays an ordinary column; only names and order change."""
    return view(spark, sf_dir, "fx_survival").select(F.col("grp").alias("group"), "sample", "os")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "transpose_matrix",
    "SELECT l_suppkey % 20 AS sample, " + ", ".join(
        f"SUM(CASE WHEN p_type = '{t}' THEN l_quantity END) AS \"{t}\"" for t in _TYPES
    ) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def transpose_matrix(spark, sf_dir):
    """Type-by-sample rows turned into one row per sample and one column per type."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    long = joined.groupBy((F.col("l_suppkey") % 20).alias("sample"), F.col("p_type").alias("feature")).agg(
        F.sum("l_quantity").alias("value")
    )
    return matrix.to_wide(long, "sample", "feature", "value", _TYPES)


@query(
    "pivot_wider",
    with_views("fx_counts", "SELECT gene, " + ", ".join(
        f"MAX(CASE WHEN sample = {s} THEN cnt END) AS \"{s}\"" for s in range(20)
    ) + " FROM fx_counts GROUP BY gene"),
)
def pivot_wider(spark, sf_dir):
    return matrix.to_wide(view(spark, sf_dir, "fx_counts"), "gene", "sample", "cnt", list(range(20)))


@query(
    "derive_column",
    with_views("fx_tmb", "SELECT patient, ROUND(LOG2(n_variants / 38.0 + 1), 6) AS burden_log, "
               "CASE WHEN grp = 0 THEN 'Sub0' ELSE 'Sub1' END AS label FROM fx_tmb"),
)
def derive_column(spark, sf_dir):
    df = view(spark, sf_dir, "fx_tmb")
    return df.select(
        "patient",
        F.round(scalar.log2p1(F.col("n_variants") / 38.0), 6).alias("burden_log"),
        F.when(F.col("grp") == 0, "Sub0").otherwise("Sub1").alias("label"),
    )


@query("bind_columns", with_views("fx_survival fx_scores", "SELECT s.sample, s.grp, r.silhouette FROM fx_survival s JOIN fx_scores r ON s.sample = r.run_id"))
def bind_columns(spark, sf_dir):
    """Two frames side by side, matched by key: rows of a distributed table have no position."""
    left = view(spark, sf_dir, "fx_survival").select("sample", "grp")
    right = view(spark, sf_dir, "fx_scores").select(F.col("run_id").alias("sample"), "silhouette")
    return left.join(right, "sample")


@query(
    "assign_positional_group_label",
    with_views("fx_survival", "SELECT sample, 1 - grp AS grp, CASE WHEN 1 - grp = 0 THEN 'Sub0' ELSE 'Sub1' END AS label FROM fx_survival"),
)
def assign_positional_group_label(spark, sf_dir):
    return diffexp.labelled(view(spark, sf_dir, "fx_survival").select("sample", "grp"), "grp", reverse=True)


# -------------------------------------------------------------------- filters


@query("filter_equal", with_views("fx_phenotype", "SELECT * FROM fx_phenotype WHERE program = 'TCGA' AND sample_type = 'Primary Tumor'"))
def filter_equal(spark, sf_dir):
    return view(spark, sf_dir, "fx_phenotype").where((F.col("program") == "TCGA") & (F.col("sample_type") == "Primary Tumor"))


_CLASSES = ", ".join(f"'{c}'" for c in matrix.MUTATION_CLASSES)


@query("filter_in_list", with_views("fx_variants", f"SELECT * FROM fx_variants WHERE variant_classification IN ({_CLASSES})"))
def filter_in_list(spark, sf_dir):
    return view(spark, sf_dir, "fx_variants").where(F.col("variant_classification").isin(matrix.MUTATION_CLASSES))


@query("filter_regex", with_views("fx_variants", "SELECT * FROM fx_variants WHERE regexp_matches(tumor_sample_barcode, 'TCGA-[A-Z0-9]+-[A-Z0-9]+-01')"))
def filter_regex(spark, sf_dir):
    return view(spark, sf_dir, "fx_variants").where(F.col("tumor_sample_barcode").rlike(scalar.PRIMARY_BARCODE))


@query("filter_not_value", with_views("fx_probe_map", "SELECT * FROM fx_probe_map WHERE gene <> '.'"))
def filter_not_value(spark, sf_dir):
    return view(spark, sf_dir, "fx_probe_map").where(F.col("gene") != ".")


@query("filter_not_null", with_views("fx_phenotype", "SELECT * FROM fx_phenotype WHERE project_id IS NOT NULL"))
def filter_not_null(spark, sf_dir):
    return view(spark, sf_dir, "fx_phenotype").na.drop(subset=["project_id"])


@query("filter_two_sided_effect", with_views("fx_deg", "SELECT * FROM fx_deg WHERE (log2fc <= -1 OR log2fc >= 1) AND pvalue < 0.05"))
def filter_two_sided_effect(spark, sf_dir):
    return diffexp.two_sided_effect(view(spark, sf_dir, "fx_deg"), 1.0, 0.05, p="pvalue")


@query("filter_significant_features", with_views("fx_deg", "SELECT * FROM fx_deg WHERE pvalue < 0.05"))
def filter_significant_features(spark, sf_dir):
    return view(spark, sf_dir, "fx_deg").where(F.col("pvalue") < 0.05)


@query(
    "filter_feature_by_zero_count",
    with_views("fx_matrix_sparse", "+n AS (SELECT COUNT(DISTINCT sample) AS n FROM fx_matrix_sparse), "
               "kept AS (SELECT feature FROM fx_matrix_sparse GROUP BY 1 HAVING COUNT(*) FILTER (WHERE value = 0) < (SELECT FLOOR(0.2 * n) FROM n)) "
               "SELECT * FROM fx_matrix_sparse WHERE feature IN (SELECT feature FROM kept)"),
)
def filter_feature_by_zero_count(spark, sf_dir):
    return matrix.filter_feature_by_zero_count(view(spark, sf_dir, "fx_matrix_sparse"))


@query(
    "filter_feature_by_null_ratio",
    with_views("fx_matrix_sparse", "+n AS (SELECT COUNT(DISTINCT sample) AS n FROM fx_matrix_sparse), "
               "kept AS (SELECT feature FROM fx_matrix_sparse GROUP BY 1 HAVING 1 - COUNT(value) / (SELECT n FROM n) < 0.8) "
               "SELECT * FROM fx_matrix_sparse WHERE feature IN (SELECT feature FROM kept)"),
)
def filter_feature_by_null_ratio(spark, sf_dir):
    return matrix.filter_feature_by_null_ratio(view(spark, sf_dir, "fx_matrix_sparse"))


@query(
    "filter_feature_by_mean_quantile",
    with_views("fx_matrix", "+m AS (SELECT feature, AVG(value) AS mean FROM fx_matrix GROUP BY 1), q AS (SELECT quantile_cont(mean, 0.25) AS q FROM m) "
               "SELECT * FROM fx_matrix WHERE feature IN (SELECT feature FROM m, q WHERE mean > q)"),
)
def filter_feature_by_mean_quantile(spark, sf_dir):
    return matrix.filter_feature_by_mean_quantile(view(spark, sf_dir, "fx_matrix"))


# ---------------------------------------------------------------------- joins

_PATIENT = "SUBSTRING(sample, 1, LENGTH(sample) - 1)"


@query(
    "join_left_enrich",
    with_views("fx_phenotype", f"+d AS (SELECT {_PATIENT} AS sample, sample_type AS sample_type_x FROM fx_phenotype), "
               f"b AS (SELECT {_PATIENT} AS sample, sample_type AS sample_type_y, project_id FROM fx_phenotype WHERE program = 'TCGA') "
               "SELECT d.sample, sample_type_x, sample_type_y, project_id FROM d LEFT JOIN b ON d.sample = b.sample"),
)
def join_left_enrich(spark, sf_dir):
    basic = view(spark, sf_dir, "fx_phenotype").withColumn("sample", scalar.drop_last_char(F.col("sample")))
    right = basic.where("program = 'TCGA'").select("sample", F.col("sample_type").alias("sample_type_y"), "project_id")
    return basic.select("sample", F.col("sample_type").alias("sample_type_x")).join(right, "sample", "left")


@query(
    "join_left_diff_keys",
    with_views("fx_matrix_sparse fx_probe_map", "SELECT sample, feature, value, gene FROM fx_matrix_sparse LEFT JOIN fx_probe_map ON feature = probe"),
)
def join_left_diff_keys(spark, sf_dir):
    probes = view(spark, sf_dir, "fx_probe_map")
    return view(spark, sf_dir, "fx_matrix_sparse").join(probes, F.col("feature") == F.col("probe"), "left").drop("probe")


@query("join_inner_key", with_views("fx_cox fx_survival", "SELECT c.sample, c.feature, c.x, s.os, s.os_time FROM fx_cox c JOIN fx_survival s ON c.sample = s.sample"))
def join_inner_key(spark, sf_dir):
    # Both sides come dealt by order, so neither the groups nor the joins grow with the tables.
    parts = partitions_for(table(spark, sf_dir, "lineitem"))
    return orders_view(spark, sf_dir, "fx_cox", parts).select("sample", "feature", "x").join(
        orders_view(spark, sf_dir, "fx_survival", parts).select("sample", "os", "os_time"), "sample"
    )


@query(
    "join_inner_nway",
    with_views("fx_matrix6", "+w AS (SELECT sample FROM fx_matrix6 GROUP BY 1 HAVING COUNT(DISTINCT modality) = 6) "
               "SELECT * FROM fx_matrix6 WHERE sample IN (SELECT sample FROM w)"),
)
def join_inner_nway(spark, sf_dir):
    return matrix.complete_samples(view(spark, sf_dir, "fx_matrix6"), 6)


_CUT_RUNS = "+cut AS (SELECT * FROM fx_deg WHERE ABS(log2fc) >= 1 AND pvalue < 0.5) "


@query(
    "join_full_outer_nway",
    with_views("fx_deg", _CUT_RUNS + "SELECT gene, " + ", ".join(
        f"MAX(CASE WHEN run_id = {r} THEN log2fc END) AS run_{r}" for r in range(10)
    ) + " FROM cut GROUP BY gene"),
)
def join_full_outer_nway(spark, sf_dir):
    cut = diffexp.two_sided_effect(view(spark, sf_dir, "fx_deg"), 1.0, 0.5, p="pvalue")
    return relational.outer_from_long(cut, "gene", "run_id", "log2fc", {r: f"run_{r}" for r in range(10)})


@query(
    "join_full_outer_fill",
    with_views("fx_variants", f"+m AS (SELECT DISTINCT hugo_symbol, SUBSTRING(tumor_sample_barcode, 6, 2) AS nation FROM fx_variants WHERE variant_classification IN ({_CLASSES})) "
               "SELECT hugo_symbol, " + ", ".join(f"MAX(CASE WHEN nation = '{n:02d}' THEN 1 ELSE 0 END) AS \"{n:02d}\"" for n in range(25)) + " FROM m GROUP BY 1"),
)
def join_full_outer_fill(spark, sf_dir):
    """Presence of a mutated gene per centre code, missing pairs filled with 0."""
    kept = view(spark, sf_dir, "fx_variants").where(F.col("variant_classification").isin(matrix.MUTATION_CLASSES))
    pairs = kept.select("hugo_symbol", scalar.barcode_part(F.col("tumor_sample_barcode"), 2).alias("centre")).distinct()
    return matrix.to_wide(pairs.withColumn("cnt", F.lit(1)), "hugo_symbol", "centre", "cnt", [f"{n:02d}" for n in range(25)], fill=0)


@query(
    "join_full_outer_pair",
    with_views("fx_deg", "+e AS (SELECT run_id || ':' || gene AS gene, log2fc AS edger_logfc FROM fx_deg WHERE pvalue < 0.5), "
               "d AS (SELECT run_id || ':' || gene AS gene, log2fc AS deseq2_logfc FROM fx_deg WHERE log2fc > 0) "
               "SELECT COALESCE(e.gene, d.gene) AS gene, edger_logfc, deseq2_logfc FROM e FULL JOIN d ON e.gene = d.gene"),
)
def join_full_outer_pair(spark, sf_dir):
    """Two cuts of all runs' results stand for the two methods."""
    deg = view(spark, sf_dir, "fx_deg").withColumn("gene", F.concat_ws(":", "run_id", "gene"))
    first = deg.where("pvalue < 0.5").select("gene", F.col("log2fc").alias("edger_logfc"))
    second = deg.where("log2fc > 0").select("gene", F.col("log2fc").alias("deseq2_logfc"))
    return relational.full_outer_pair(first, second, "gene")


@query("join_left_group", with_views("fx_survival fx_scores", "SELECT s.sample, s.grp, r.tmb_p FROM fx_survival s LEFT JOIN fx_scores r ON s.sample = r.run_id"))
def join_left_group(spark, sf_dir):
    burden = view(spark, sf_dir, "fx_scores").select(F.col("run_id").alias("sample"), "tmb_p")
    return view(spark, sf_dir, "fx_survival").select("sample", "grp").join(burden, "sample", "left")


_LONG_BARCODE = "array_to_string(string_split(tumor_sample_barcode, '-')[1:4], '-')"


@query(
    "join_semi_samples",
    with_views("fx_variants fx_phenotype", f"SELECT DISTINCT {_LONG_BARCODE} AS sample FROM fx_variants WHERE {_LONG_BARCODE} IN (SELECT sample FROM fx_phenotype WHERE program = 'TCGA')"),
)
def join_semi_samples(spark, sf_dir):
    header = view(spark, sf_dir, "fx_variants").select(scalar.barcode_parts(F.col("tumor_sample_barcode"), 4).alias("sample"))
    cohort = view(spark, sf_dir, "fx_phenotype").where("program = 'TCGA'").select("sample")
    return header.distinct().join(cohort, "sample", "left_semi")


@query("join_anti_pending", with_views("fx_survival fx_scores", "SELECT sample FROM fx_survival WHERE sample NOT IN (SELECT run_id FROM fx_scores)"))
def join_anti_pending(spark, sf_dir):
    done = view(spark, sf_dir, "fx_scores").select(F.col("run_id").alias("sample"))
    return view(spark, sf_dir, "fx_survival").select("sample").join(done, "sample", "left_anti")


@query(
    "join_skip_missing",
    with_views("fx_counts", "SELECT a.gene, a.total AS total_a, b.total AS total_b FROM (SELECT gene, SUM(cnt)::BIGINT AS total FROM fx_counts WHERE grp = 0 GROUP BY 1) a "
               "JOIN (SELECT gene, SUM(cnt)::BIGINT AS total FROM fx_counts WHERE grp = 1 GROUP BY 1) b ON a.gene = b.gene"),
)
def join_skip_missing(spark, sf_dir):
    """Three studies of which one was never loaded."""
    counts = view(spark, sf_dir, "fx_counts")

    def study(grp, name):
        return counts.where(F.col("grp") == grp).groupBy("gene").agg(F.sum("cnt").alias(name))

    return relational.join_without_missing([study(0, "total_a"), None, study(1, "total_b")], "gene")


# ----------------------------------------------------------------- aggregates


@query("agg_group_mean", with_views("fx_matrix_sparse fx_probe_map", "SELECT sample, gene, ROUND(AVG(value), 6) AS value FROM fx_matrix_sparse JOIN fx_probe_map ON feature = probe WHERE gene IS NOT NULL GROUP BY 1, 2"))
def agg_group_mean(spark, sf_dir):
    # fx_matrix_sparse with the numbers for names until its cells are summed: rows dealt by the numbers are grouped where they are.
    items = table(spark, sf_dir, "lineitem")
    parts = partitions_for(items)
    kept = F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).otherwise(0)
    cells = items.repartition(parts, "l_partkey", "l_suppkey").groupBy("l_suppkey", "l_partkey").agg(F.sum(kept).alias("value"))
    matrix = cells.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature"), "value"
    )
    probes = view(spark, sf_dir, "fx_probe_map").where("gene IS NOT NULL")
    joined = matrix.repartition(parts, "feature").join(probes.repartition(parts, "probe"), F.col("feature") == F.col("probe"))
    return joined.repartition(parts, "sample", "gene").groupBy("sample", "gene").agg(F.round(F.avg("value"), 6).alias("value"))


@query("agg_group_presence", with_views("fx_variants", "SELECT DISTINCT tumor_sample_barcode, hugo_symbol, 1 AS cnt FROM fx_variants"))
def agg_group_presence(spark, sf_dir):
    return view(spark, sf_dir, "fx_variants").select("tumor_sample_barcode", "hugo_symbol").distinct().withColumn("cnt", F.lit(1))


@query("agg_count_per_sample", with_views("fx_variants", "SELECT tumor_sample_barcode, COUNT(*) AS n, ROUND(COUNT(*) / 38.0, 6) AS total_per_mb FROM fx_variants GROUP BY 1"))
def agg_count_per_sample(spark, sf_dir):
    counted = view(spark, sf_dir, "fx_variants").groupBy("tumor_sample_barcode").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("total_per_mb", F.round(F.col("n") / F.lit(38.0), 6))


@query("agg_distinct_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def agg_distinct_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return lists.first_per_key(orders, ["o_custkey"], ["o_orderkey"])


@query("agg_row_null_count", with_views("fx_deg", _CUT_RUNS + "SELECT gene, ROUND(100.0 * COUNT(log2fc) / 10, 6) AS not_blank_percent FROM cut GROUP BY 1"))
def agg_row_null_count(spark, sf_dir):
    cut = diffexp.two_sided_effect(view(spark, sf_dir, "fx_deg"), 1.0, 0.5, p="pvalue")
    return cut.groupBy("gene").agg(F.round(F.count("log2fc") * 100.0 / 10, 6).alias("not_blank_percent"))


@query("agg_row_median_mean", with_views("fx_deg", "SELECT gene, ROUND(MEDIAN(log2fc), 10) AS median, ROUND(AVG(log2fc), 10) AS mean FROM fx_deg GROUP BY 1"))
def agg_row_median_mean(spark, sf_dir):
    return view(spark, sf_dir, "fx_deg").groupBy("gene").agg(
        F.round(F.median("log2fc"), 10).alias("median"), F.round(F.avg("log2fc"), 10).alias("mean")
    )


@query("agg_string_concat", with_views("fx_links", "SELECT gene, string_agg(DISTINCT entry, ';' ORDER BY entry) AS joined, COUNT(DISTINCT entry) AS n, 0 AS part FROM fx_links GROUP BY 1"))
def agg_string_concat(spark, sf_dir):
    return relational.joined_text(view(spark, sf_dir, "fx_links"), "gene", "entry")


@query("agg_count_distinct", with_views("fx_links", "SELECT gene, COUNT(DISTINCT id) AS n FROM (SELECT gene, unnest(string_split(pdb, ';')) AS id FROM fx_links) WHERE id <> '' GROUP BY 1"))
def agg_count_distinct(spark, sf_dir):
    ids = view(spark, sf_dir, "fx_links").select("gene", F.explode(F.split("pdb", ";")).alias("id")).where("id <> ''")
    return ids.groupBy("gene").agg(F.countDistinct("id").alias("n"))


@query(
    "agg_multimap",
    with_views("fx_oncogenes fx_links", "SELECT gene, string_agg(v, ',' ORDER BY f, v) AS \"values\", 0 AS part FROM (SELECT gene, 0 AS f, is_oncogene AS v FROM fx_oncogenes UNION ALL "
               "SELECT gene, 1 AS f, entry AS v FROM fx_links) GROUP BY gene"),
)
def agg_multimap(spark, sf_dir):
    first = view(spark, sf_dir, "fx_oncogenes").select("gene", F.col("is_oncogene").alias("v"))
    second = view(spark, sf_dir, "fx_links").select("gene", F.col("entry").alias("v"))
    return relational.multimap([first, second], "gene", "v").withColumn("values", F.array_join("values", ","))


@query("agg_group_means_table", with_views("fx_counts", "SELECT gene, ROUND(AVG(cnt) FILTER (WHERE grp = 0), 6) AS mean_0, ROUND(AVG(cnt) FILTER (WHERE grp = 1), 6) AS mean_1 FROM fx_counts GROUP BY 1"))
def agg_group_means_table(spark, sf_dir):
    return view(spark, sf_dir, "fx_counts").groupBy("gene").agg(
        F.round(F.avg(F.when(F.col("grp") == 0, F.col("cnt"))), 6).alias("mean_0"),
        F.round(F.avg(F.when(F.col("grp") == 1, F.col("cnt"))), 6).alias("mean_1"),
    )


@query("agg_mean_std", with_views("fx_matrix", "SELECT feature, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_POP(value), 6) AS std FROM fx_matrix GROUP BY 1"))
def agg_mean_std(spark, sf_dir):
    return view(spark, sf_dir, "fx_matrix").groupBy("feature").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std")
    )


@query("agg_min_max", with_views("fx_matrix", "SELECT feature, MIN(value) AS low, MAX(value) AS high FROM fx_matrix GROUP BY 1"))
def agg_min_max(spark, sf_dir):
    return view(spark, sf_dir, "fx_matrix").groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query(
    "agg_region_counts",
    with_views("fx_sets", "+m AS (SELECT item, BIT_OR(1 << (5 - set_no)) AS mask FROM fx_sets GROUP BY 1), c AS (SELECT mask, COUNT(*) AS n FROM m GROUP BY 1), "
               "t AS (SELECT COUNT(*) AS total FROM m), r AS (SELECT r::INTEGER AS mask FROM range(1, 64) AS t(r)), "
               "x AS (SELECT right('000000' || bin(r.mask), 6) AS region, COALESCE(n, 0) AS n, total AS union_size FROM r LEFT JOIN c ON r.mask = c.mask CROSS JOIN t) "
               "SELECT region, n, union_size, region || ': ' || n || printf('(%.1f%%)', 100.0 * n / union_size) AS label FROM x"),
)
def agg_region_counts(spark, sf_dir):
    regions = matrix.region_counts(view(spark, sf_dir, "fx_sets"), 6)
    return matrix.region_labels(regions, ["logic", "number", "percent"])


# -------------------------------------------------------------- window shapes


@query("win_first_per_key", "SELECT p_name AS symbol, p_partkey, p_brand FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def win_first_per_key(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), "p_partkey", "p_brand")
    return lists.first_per_key(part, ["symbol"], ["p_partkey"])


@query(
    "win_rank_features",
    with_views("fx_counts", "+t AS (SELECT gene, SUM(cnt)::BIGINT AS score FROM fx_counts GROUP BY 1), r AS (SELECT gene, score, ROW_NUMBER() OVER (ORDER BY score DESC, gene) AS rank FROM t) "
               "SELECT gene, score, rank FROM r WHERE rank BETWEEN 2 AND 50"),
)
def win_rank_features(spark, sf_dir):
    """The first fifty features by score without the best one: the ranks the reference analysis reports."""
    totals = view(spark, sf_dir, "fx_counts").groupBy("gene").agg(F.sum("cnt").alias("score"))
    return sampling.top_features(totals, "score", "gene", 50, skip_first=True)


@query(
    "win_fdr_bh",
    with_views("fx_deg", "+r AS (SELECT run_id, gene, pvalue, COUNT(*) OVER (PARTITION BY run_id) AS m, RANK() OVER (PARTITION BY run_id ORDER BY pvalue) + COUNT(*) OVER (PARTITION BY run_id, pvalue) - 1 AS i FROM fx_deg WHERE pvalue IS NOT NULL) "
               "SELECT run_id, gene, ROUND(MIN(LEAST(1.0, pvalue * m / i)) OVER (PARTITION BY run_id ORDER BY pvalue DESC), 6) AS padj FROM r"),
)
def win_fdr_bh(spark, sf_dir):
    adjusted = diffexp.fdr_bh(view(spark, sf_dir, "fx_deg"), "pvalue", ["run_id"])
    return adjusted.select("run_id", "gene", F.round("padj", 6).alias("padj"))


@query("win_batch_number", with_views("fx_scores", "SELECT run_id, CEIL(ROW_NUMBER() OVER (ORDER BY run_id) / 200.0)::BIGINT AS batch FROM fx_scores"))
def win_batch_number(spark, sf_dir):
    return sampling.batch_numbers(view(spark, sf_dir, "fx_scores").select("run_id"), "run_id", 200)


# ------------------------------------------------------ sort, limit, sampling


@query("sort_result", with_views("fx_oncogenes", "SELECT gene, is_oncogene FROM fx_oncogenes ORDER BY gene"))
def sort_result(spark, sf_dir):
    return view(spark, sf_dir, "fx_oncogenes").select("gene", "is_oncogene").orderBy("gene")


@query("argmax_model", with_views("fx_scores", "SELECT run_id AS model, silhouette AS score FROM fx_scores ORDER BY silhouette DESC, run_id LIMIT 1"))
def argmax_model(spark, sf_dir):
    """Best score; equal scores go to the smaller name. A global maximum, combined before the one-row shuffle."""
    scores = view(spark, sf_dir, "fx_scores")
    best = scores.agg(F.max(F.struct("silhouette", (-F.col("run_id")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("model"), F.col("b.silhouette").alias("score"))


@query("topk_features", with_views("fx_counts", "SELECT gene, SUM(cnt)::BIGINT AS score FROM fx_counts GROUP BY 1 ORDER BY score DESC, gene LIMIT 20"))
def topk_features(spark, sf_dir):
    totals = view(spark, sf_dir, "fx_counts").groupBy("gene").agg(F.sum("cnt").alias("score"))
    return totals.orderBy(F.desc("score"), "gene").limit(20)


@query(
    "split_train_test",
    with_views("fx_survival", "+r AS (SELECT sample, ROW_NUMBER() OVER (ORDER BY md5('21-' || sample), sample) AS rn, COUNT(*) OVER () AS n FROM fx_survival) "
               "SELECT sample, CASE WHEN rn <= CEIL(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r"),
)
def split_train_test(spark, sf_dir):
    return sampling.split_train_test(view(spark, sf_dir, "fx_survival").select("sample"), "sample", 0.2, 21)


# ----------------------------------------------------------------- set shapes


@query("set_intersect", with_views("fx_survival fx_scores", "SELECT sample FROM fx_survival INTERSECT SELECT run_id FROM fx_scores"))
def set_intersect(spark, sf_dir):
    return view(spark, sf_dir, "fx_survival").select("sample").intersect(view(spark, sf_dir, "fx_scores").select("run_id"))


@query("set_union_distinct", with_views("fx_survival fx_scores", "SELECT sample FROM fx_survival UNION SELECT run_id FROM fx_scores"))
def set_union_distinct(spark, sf_dir):
    return view(spark, sf_dir, "fx_survival").select("sample").union(view(spark, sf_dir, "fx_scores").select("run_id")).distinct()


@query("set_except", with_views("fx_survival fx_scores", "SELECT sample FROM fx_survival EXCEPT SELECT run_id FROM fx_scores"))
def set_except(spark, sf_dir):
    return view(spark, sf_dir, "fx_survival").select("sample").subtract(view(spark, sf_dir, "fx_scores").select("run_id"))


@query("union_all", "SELECT p_name AS name, p_size AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_all_query(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_all([parts, suppliers])


@query("set_distinct", with_views("fx_variants", "SELECT DISTINCT tumor_sample_barcode FROM fx_variants"))
def set_distinct(spark, sf_dir):
    return view(spark, sf_dir, "fx_variants").select("tumor_sample_barcode").distinct()


# ------------------------------------------------------------ scalar functions


@query("fn_drop_last_char", with_views("fx_phenotype", "SELECT sample, SUBSTRING(sample, 1, LENGTH(sample) - 1) AS short FROM fx_phenotype"))
def fn_drop_last_char(spark, sf_dir):
    return view(spark, sf_dir, "fx_phenotype").select("sample", scalar.drop_last_char(F.col("sample")).alias("short"))


@query("fn_regex_extract", with_views("fx_variants", "SELECT tumor_sample_barcode, regexp_extract(tumor_sample_barcode, 'TCGA-[A-Za-z0-9]+-[A-Za-z0-9]+-[0-9]+') AS sample FROM fx_variants"))
def fn_regex_extract(spark, sf_dir):
    barcode = F.col("tumor_sample_barcode")
    return view(spark, sf_dir, "fx_variants").select(barcode, scalar.matched(barcode, scalar.SAMPLE_BARCODE).alias("sample"))


@query("fn_regex_replace", "SELECT p_partkey, regexp_replace(p_name || '.maf.gz', '.maf.gz', '') AS name FROM part")
def fn_regex_replace(spark, sf_dir):
    named = F.concat("p_name", F.lit(".maf.gz"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.without_suffix(named, r"\.maf\.gz").alias("name"))


@query("fn_split_unite", with_views("fx_variants", "SELECT tumor_sample_barcode, array_to_string(string_split(tumor_sample_barcode, '-')[1:4], '-') AS sample, string_split(tumor_sample_barcode, '-')[4] AS d FROM fx_variants"))
def fn_split_unite(spark, sf_dir):
    barcode = F.col("tumor_sample_barcode")
    return view(spark, sf_dir, "fx_variants").select(
        barcode, scalar.barcode_parts(barcode, 4).alias("sample"), scalar.barcode_part(barcode, 4).alias("d")
    )


@query("fn_barcode_sample_type", with_views("fx_phenotype", "SELECT sample, CASE SUBSTRING(string_split(sample, '-')[4], 1, 2) WHEN '01' THEN 'TP' WHEN '11' THEN 'NT' END AS kind FROM fx_phenotype"))
def fn_barcode_sample_type(spark, sf_dir):
    return view(spark, sf_dir, "fx_phenotype").select("sample", scalar.sample_type(F.col("sample")).alias("kind"))


@query("fn_concat_format", with_views("fx_deg", "SELECT 'COAD_DESEQ2_' || run_id || '.txt' AS file, gene || ':' || printf('%.6f', log2fc) AS text FROM fx_deg"))
def fn_concat_format(spark, sf_dir):
    return view(spark, sf_dir, "fx_deg").select(
        F.concat(F.concat_ws("_", F.lit("COAD"), F.lit("DESEQ2"), "run_id"), F.lit(".txt")).alias("file"),
        F.format_string("%s:%.6f", "gene", "log2fc").alias("text"),
    )


@query("fn_upper", "SELECT p_partkey, UPPER(p_name) AS name FROM part")
def fn_upper(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"))


@query("fn_empty_if_null", with_views("fx_probe_map", "SELECT probe, COALESCE(gene, '') AS gene FROM fx_probe_map"))
def fn_empty_if_null(spark, sf_dir):
    return view(spark, sf_dir, "fx_probe_map").select("probe", scalar.empty_if_null(F.col("gene")).alias("gene"))


@query("fn_log2p1", with_views("fx_matrix", "SELECT sample, feature, ROUND(LOG2(value + 1), 6) AS value FROM fx_matrix"))
def fn_log2p1(spark, sf_dir):
    return view(spark, sf_dir, "fx_matrix").withColumn("value", F.round(scalar.log2p1(F.col("value")), 6))


@query("fn_percent", "SELECT o_orderstatus, printf('%.1f%%', 100.0 * COUNT(*) / (SELECT COUNT(*) FROM orders)) AS share FROM orders GROUP BY 1")
def fn_percent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.agg(F.sum("n").alias("total"))
    return ordered.with_row(parts, whole).select("o_orderstatus", scalar.percent_text(F.col("n"), F.col("total")).alias("share"))


@query("fn_floor_fraction", with_views("fx_matrix6", "SELECT modality, FLOOR(COUNT(DISTINCT sample) * 0.2)::BIGINT AS allowed FROM fx_matrix6 GROUP BY 1"))
def fn_floor_fraction(spark, sf_dir):
    counts = matrix.sample_counts(view(spark, sf_dir, "fx_matrix6"), ["modality"])
    return counts.select("modality", scalar.floor_fraction(F.col("n_samples"), 0.2).alias("allowed"))


@query("fn_bitstring", "SELECT p_partkey, right('000000' || bin(p_size % 64), 6) AS bits FROM part")
def fn_bitstring(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.bit_string(F.col("p_size") % 64, 6).alias("bits"))


@query("fn_null_fill", with_views("fx_links", "SELECT gene, entry, COALESCE(pdb, '0') AS pdb FROM fx_links"))
def fn_null_fill(spark, sf_dir):
    return view(spark, sf_dir, "fx_links").select("gene", "entry", "pdb").na.fill("0", subset=["pdb"])


@query("fn_type_branch", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ';' || p_type ELSE p_brand END AS ids, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n FROM part")
def fn_type_branch(spark, sf_dir):
    raw = F.when(F.col("p_size") % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    text, count = scalar.text_or_list(F.col("raw"))
    return table(spark, sf_dir, "part").withColumn("raw", raw).select("p_partkey", text.alias("ids"), count.alias("n"))


@query("fn_array_dedupe_join", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name, ' '))), ' ') AS words FROM part")
def fn_array_dedupe_join(spark, sf_dir):
    doubled = F.concat_ws(" ", "p_name", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.distinct_joined(doubled, " ").alias("words"))


@query("fn_array_transform", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w || ';' || p_size), '&') AS text FROM part")
def fn_array_transform(spark, sf_dir):
    listed = F.transform(F.split("p_name", " "), lambda w: F.concat_ws(";", w, F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(listed, "&").alias("text"))


@query("fn_filter_none", with_views("fx_links", "SELECT gene, entry, array_to_string(list_filter([pdb, '', entry], lambda x: x IS NOT NULL AND x <> ''), '+') AS kept FROM fx_links"))
def fn_filter_none(spark, sf_dir):
    items = F.array("pdb", F.lit(""), "entry")
    return view(spark, sf_dir, "fx_links").select("gene", "entry", F.array_join(scalar.kept_items(items), "+").alias("kept"))


@query("fn_array_size", "SELECT doc_id, CAST(length(string_split(text, ' ')) AS INTEGER) AS n_words FROM documents")
def fn_array_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n_words"))


@query("fn_timestamp_format", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS run_id FROM events")
def fn_timestamp_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.run_id_of(F.col("ts")).alias("run_id"))


@query("fn_multiset_isin_zero", with_views("fx_matrix_sparse", "SELECT sample, feature, value = 0 AS is_zero FROM fx_matrix_sparse"))
def fn_multiset_isin_zero(spark, sf_dir):
    return view(spark, sf_dir, "fx_matrix_sparse").select("sample", "feature", (F.col("value") == 0).alias("is_zero"))
