"""Queries for scaling, tests, survival and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import matrix, sampling, stats, survival
from cohortloom.plans.registry import query
from cohortloom.plans.views import orders_view, table, view, with_views

_SCALE = "JOIN (SELECT feature, AVG(value) AS m, STDDEV_POP(value) AS s, MIN(value) AS lo, MAX(value) AS hi FROM fx_matrix GROUP BY 1) q USING (feature)"


@query("scale_standard", with_views("fx_matrix", f"SELECT sample, feature, ROUND((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS value FROM fx_matrix {_SCALE}"))
def scale_standard(spark, sf_dir):
    scaled = stats.scale_standard(view(spark, sf_dir, "fx_matrix"))
    return scaled.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("scale_minmax", with_views("fx_matrix", f"SELECT sample, feature, ROUND((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS value FROM fx_matrix {_SCALE}"))
def scale_minmax(spark, sf_dir):
    return stats.scale_minmax(view(spark, sf_dir, "fx_matrix")).withColumn("value", F.round("value", 6))


_TMB = (
    "+tmb AS (SELECT tumor_sample_barcode AS b, COUNT(*) AS total FROM fx_variants WHERE variant_classification IN ("
    + ", ".join(f"'{c}'" for c in stats.NONSYNONYMOUS)
    + ") GROUP BY 1), kept AS (SELECT SUBSTRING(b, 1, 17) AS sample, total, total / 38.0 AS total_per_mb, LOG2(total / 38.0 + 1) AS total_per_mb_log "
    "FROM tmb WHERE string_split(b, '-')[4] = '01A') "
)


@query("tmb_per_sample", with_views("fx_variants", _TMB + "SELECT sample, total, ROUND(total_per_mb, 6) AS total_per_mb, ROUND(total_per_mb_log, 6) AS total_per_mb_log FROM kept"))
def tmb_per_sample(spark, sf_dir):
    burden = stats.tmb_per_sample(view(spark, sf_dir, "fx_variants"))
    return burden.select("sample", "total", F.round("total_per_mb", 6).alias("total_per_mb"), F.round("total_per_mb_log", 6).alias("total_per_mb_log"))


def _burden_groups(spark, sf_dir):
    burden = view(spark, sf_dir, "fx_tmb")
    return burden.withColumn("burden_log", F.log2(F.col("n_variants") / F.lit(38.0) + 1))


_WELCH = """+s AS (SELECT COUNT(*) FILTER (grp = 0) AS n0, COUNT(*) FILTER (grp = 1) AS n1, AVG(b) FILTER (grp = 0) AS m0, AVG(b) FILTER (grp = 1) AS m1,
    VAR_SAMP(b) FILTER (grp = 0) AS v0, VAR_SAMP(b) FILTER (grp = 1) AS v1 FROM (SELECT grp, LOG2(n_variants / 38.0 + 1) AS b FROM fx_tmb))
    SELECT n0, n1, ROUND((m0 - m1) / SQRT(v0 / n0 + v1 / n1), 6) AS t,
    ROUND(POWER(v0 / n0 + v1 / n1, 2) / (POWER(v0 / n0, 2) / (n0 - 1) + POWER(v1 / n1, 2) / (n1 - 1)), 6) AS df FROM s"""


@query("test_welch_t", with_views("fx_tmb", _WELCH))
def test_welch_t(spark, sf_dir):
    result = stats.welch_t(_burden_groups(spark, sf_dir), "burden_log", "grp")
    return result.select("n0", "n1", F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


@query("test_welch_t_pvalue")
def test_welch_t_pvalue(spark, sf_dir):
    return stats.welch_t(_burden_groups(spark, sf_dir), "burden_log", "grp")


_RISK = """+c AS (SELECT grp, os_time AS time, COUNT(*) AS leaving, SUM(os)::BIGINT AS deaths FROM fx_survival GROUP BY 1, 2),
    r AS (SELECT grp, time, leaving, deaths, (SUM(leaving) OVER (PARTITION BY grp ORDER BY time DESC))::BIGINT AS at_risk FROM c),
    k AS (SELECT *, product(1 - deaths / at_risk) OVER (PARTITION BY grp ORDER BY time) AS survival FROM r) """


@query("win_km_curve", with_views("fx_survival", _RISK + "SELECT grp, time, at_risk, deaths, ROUND(survival, 9) AS survival FROM k"))
def win_km_curve(spark, sf_dir):
    curve = survival.km_curve(view(spark, sf_dir, "fx_survival"), "grp", "os_time", "os")
    return curve.withColumn("survival", F.round("survival", 9))


_RMST = _RISK.rstrip() + """, l AS (SELECT *, LAG(survival, 1, 1.0) OVER (PARTITION BY grp ORDER BY time) AS before, LAG(time, 1, 0) OVER (PARTITION BY grp ORDER BY time) AS since,
      MAX(time) OVER () AS top, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY time DESC) AS last FROM k),
    a AS (SELECT grp, SUM(leaving)::BIGINT AS n, SUM(deaths)::BIGINT AS events, SUM(before * (time - since) + CASE WHEN last = 1 THEN survival * (top - time) ELSE 0 END) AS rmst,
      MIN(time) FILTER (survival <= 0.5) AS median FROM l GROUP BY grp) """


@query("km_median_rmst", with_views("fx_survival", _RMST + "SELECT grp, n, events, ROUND(rmst, 6) AS rmst, median::DOUBLE AS median FROM a"))
def km_median_rmst(spark, sf_dir):
    summary = survival.km_summary(view(spark, sf_dir, "fx_survival"), "grp", "os_time", "os")
    return summary.withColumn("rmst", F.round("rmst", 6))


@query("orient_groups", with_views("fx_survival", _RMST + "SELECT ROUND(MAX(rmst) FILTER (grp = 0), 6) AS rmst_0, ROUND(MAX(rmst) FILTER (grp = 1), 6) AS rmst_1, "
       "NOT (MAX(rmst) FILTER (grp = 0) > MAX(rmst) FILTER (grp = 1)) AS reverse FROM a"))
def orient_groups(spark, sf_dir):
    flag = survival.orient_groups(view(spark, sf_dir, "fx_survival"), "grp", "os_time", "os")
    return flag.select(F.round("rmst_0", 6).alias("rmst_0"), F.round("rmst_1", 6).alias("rmst_1"), "reverse")


_TERMS = """+c AS (SELECT os_time AS time, COUNT(*) AS leaving, COUNT(*) FILTER (grp = 1) AS leaving_1, SUM(os)::BIGINT AS d, (SUM(os) FILTER (grp = 1))::BIGINT AS d1 FROM fx_survival GROUP BY 1),
    r AS (SELECT time, d, COALESCE(d1, 0) AS d1, (SUM(leaving) OVER (ORDER BY time DESC))::BIGINT AS n, (SUM(leaving_1) OVER (ORDER BY time DESC))::BIGINT AS n1 FROM c),
    t AS (SELECT time, d, n, d1 AS observed, d * (n1 / n) AS expected, CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END AS variance FROM r WHERE d > 0) """


@query("win_logrank_terms", with_views("fx_survival", _TERMS + "SELECT time, d, n, observed, ROUND(expected, 9) AS expected, ROUND(variance, 9) AS variance FROM t"))
def win_logrank_terms(spark, sf_dir):
    terms = survival.logrank_terms(view(spark, sf_dir, "fx_survival"), "grp", "os_time", "os")
    return terms.select("time", "d", "n", "observed", F.round("expected", 9).alias("expected"), F.round("variance", 9).alias("variance"))


@query("test_logrank", with_views("fx_survival", _TERMS + "SELECT SUM(observed)::BIGINT AS observed, ROUND(SUM(expected), 6) AS expected, ROUND(SUM(variance), 6) AS variance, "
       "ROUND(POWER(SUM(observed) - SUM(expected), 2) / SUM(variance), 6) AS chisq FROM t"))
def test_logrank(spark, sf_dir):
    result = survival.logrank(view(spark, sf_dir, "fx_survival"), "grp", "os_time", "os")
    return result.select("observed", *[F.round(c, 6).alias(c) for c in ("expected", "variance", "chisq")])


@query("test_logrank_pvalue")
def test_logrank_pvalue(spark, sf_dir):
    return survival.logrank(view(spark, sf_dir, "fx_survival"), "grp", "os_time", "os")


@query("cox_univariate_scan")
def cox_univariate_scan(spark, sf_dir):
    """Every feature with its coefficient and likelihood-ratio p; the cut at 0.05 is the default of the operator."""
    return survival.cox_univariate_scan(orders_view(spark, sf_dir, "fx_cox"), "feature", "x", "os_time", "os", alpha=None)


@query("cox_start", with_views("fx_cox", """+v AS (SELECT feature, os_time, os, x::DOUBLE AS x FROM fx_cox),
    k AS (SELECT feature, AVG(x) AS c, SQRT(AVG(x * x) - AVG(x) * AVG(x)) AS s FROM v GROUP BY 1),
    z AS (SELECT feature, os_time, os, (x - c) / s AS z FROM v JOIN k USING (feature)),
    t AS (SELECT feature, os_time, COUNT(*) AS r0, SUM(z) AS r1, SUM(z * z) AS r2, SUM(os)::BIGINT AS d, SUM(os * z) AS d1, SUM(os * z * z) AS d2 FROM z GROUP BY 1, 2),
    q AS (SELECT *, SUM(r0) OVER w AS s0, SUM(r1) OVER w AS s1, SUM(r2) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY feature ORDER BY os_time DESC)),
    e AS (SELECT *, unnest(range(d)) AS l FROM q WHERE d > 0)
    SELECT feature, ROUND(-SUM(LN(s0 - l)), 4) AS loglik, ROUND(SUM(d1 / d - (s1 - l / d * d1) / (s0 - l)), 4) + 0.0 AS score,
           ROUND(SUM((s2 - l / d * d2) / (s0 - l) - POWER((s1 - l / d * d1) / (s0 - l), 2)), 4) AS info FROM e GROUP BY 1"""))
def cox_start(spark, sf_dir):
    """Where the scan starts: the terms of the tied deaths at coefficient 0, in plain SQL next to it."""
    found = survival.cox_start(orders_view(spark, sf_dir, "fx_cox"), "feature", "x", "os_time", "os")
    return found.select("feature", F.round("loglik", 4).alias("loglik"), (F.round("score", 4) + F.lit(0.0)).alias("score"), F.round("info", 4).alias("info"))


def cells_long(spark, sf_dir, extra=("grp",)):
    """The labelled vectors in long form, features by position."""
    rows = view(spark, sf_dir, "fx_cells").select("sample", *extra, F.posexplode("embedding").alias("at", "value"))
    return rows.select("sample", *extra, F.concat(F.lit("Feature"), F.col("at") + 1).alias("feature"), F.col("value").cast("double").alias("value"))


_CELLS = "+cells AS (SELECT sample, grp, 'Feature' || i AS feature, embedding[i]::DOUBLE AS value FROM fx_cells, range(1, 65) AS t(i))"

_ANOVA = _CELLS + """, g AS (SELECT feature, grp, COUNT(*) AS n, AVG(value) AS mean, VAR_SAMP(value) AS v FROM cells GROUP BY 1, 2),
    a AS (SELECT feature, COUNT(*) AS total, AVG(value) AS grand FROM cells GROUP BY 1)
    SELECT feature, ROUND((SUM(n * POWER(mean - grand, 2)) / (COUNT(*) - 1)) / (SUM((n - 1) * v) / (MAX(total) - COUNT(*))), 6) AS f,
    COUNT(*) - 1 AS d1, MAX(total) - COUNT(*) AS d2 FROM g JOIN a USING (feature) GROUP BY feature"""


@query("score_anova_f", with_views("fx_cells", _ANOVA))
def score_anova_f(spark, sf_dir):
    return stats.anova_f(cells_long(spark, sf_dir), "grp").select("feature", F.round("f", 6).alias("f"), "d1", "d2")


_MI = _CELLS + """, near AS (SELECT a.feature, a.sample, a.value AS x, list_sort(list(ABS(b.value - a.value))) AS ds, COUNT(*) + 1 AS nc
      FROM cells a JOIN cells b ON a.feature = b.feature AND a.grp = b.grp AND a.sample <> b.sample GROUP BY 1, 2, 3),
    q AS (SELECT feature, sample, x, nc, LEAST(3, nc - 1) AS k, ds[LEAST(3, nc - 1)] AS d FROM near),
    m AS (SELECT q.feature, q.sample, ANY_VALUE(nc) AS nc, ANY_VALUE(k) AS k, COUNT(*) AS m FROM q JOIN cells c ON c.feature = q.feature
      AND CASE WHEN d = 0 THEN c.value = x ELSE ABS(c.value - x) < d END GROUP BY 1, 2),
    h AS (SELECT n, SUM(CASE WHEN n > 1 THEN 1.0 / (n - 1) ELSE 0 END) OVER (ORDER BY n) AS psi FROM range(1, (SELECT COUNT(*) + 1 FROM fx_cells)) AS t(n))
    SELECT feature, ROUND(GREATEST((SELECT psi FROM h WHERE n = (SELECT COUNT(*) FROM fx_cells)) + AVG(hk.psi) - AVG(hc.psi) - AVG(hm.psi), 0), 6) + 0.0 AS mi
    FROM m JOIN h hk ON hk.n = k JOIN h hc ON hc.n = nc JOIN h hm ON hm.n = m GROUP BY feature"""


@query("score_mutual_info", with_views("fx_cells", _MI))
def score_mutual_info(spark, sf_dir):
    return stats.mutual_information(cells_long(spark, sf_dir), "grp").select("feature", (F.round("mi", 6) + F.lit(0.0)).alias("mi"))


@query("metric_rmsle", "SELECT ROUND(SQRT(AVG(POWER(LN(1 + GREATEST(l_quantity * 1000, 1e-7)) - LN(1 + GREATEST(l_extendedprice, 1e-7)), 2))), 6) AS rmsle FROM lineitem")
def metric_rmsle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("guess"))
    return stats.rmsle(rows, "l_extendedprice", "guess").select(F.round("rmsle", 6).alias("rmsle"))


@query("metric_f1_micro", "SELECT l_linenumber, ROUND(100 * AVG(CASE WHEN l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM lineitem GROUP BY 1")
def metric_f1_micro(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("guess", F.when(F.col("l_linestatus") == "F", "A").otherwise("N"))
    return stats.f1_micro(rows, "l_returnflag", "guess", ["l_linenumber"]).withColumn("f1", F.round("f1", 6))


@query(
    "cv_repeated_stratified",
    with_views("fx_cells", "+r AS (SELECT sample, label, repeat FROM fx_cells, range(0, 2) AS t(repeat)) "
               "SELECT sample, label, repeat::INTEGER AS repeat, ((ROW_NUMBER() OVER (PARTITION BY repeat, label ORDER BY md5('331-' || repeat || '-' || sample), sample) - 1) % 10)::INTEGER AS fold FROM r"),
)
def cv_repeated_stratified(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_cells").select("sample", "label")
    return sampling.repeated_stratified_folds(rows, "sample", "label", 10, 2, 331)


_SHORT = "SUBSTRING(sample, 1, LENGTH(sample) - 1)"


@query(
    "cohort_select",
    with_views("fx_phenotype fx_variants", f"+header AS (SELECT DISTINCT array_to_string(string_split(tumor_sample_barcode, '-')[1:3], '-') || '-' || SUBSTRING(string_split(tumor_sample_barcode, '-')[4], 1, 2) AS sample FROM fx_variants), "
               f"b AS (SELECT {_SHORT} AS sample, sample_type, project_id FROM (SELECT DISTINCT ON (sample) * FROM fx_phenotype WHERE program = 'TCGA' ORDER BY sample, sample_type, project_id)), "
               f"d AS (SELECT {_SHORT} AS sample FROM fx_phenotype) "
               "SELECT DISTINCT h.sample FROM header h JOIN d ON d.sample = h.sample JOIN b ON b.sample = d.sample WHERE b.project_id = 'TCGA-BUIL' AND b.sample_type = 'Primary Tumor'"),
)
def cohort_select(spark, sf_dir):
    from cohortloom.functions import scalar

    basic = view(spark, sf_dir, "fx_phenotype")
    dense = basic.select(scalar.drop_last_char(F.col("sample")).alias("sample"))
    header = view(spark, sf_dir, "fx_variants").select(scalar.matched(F.col("tumor_sample_barcode"), scalar.SAMPLE_BARCODE).alias("sample"))
    return matrix.cohort_select(header, basic, dense, "BUIL")


@query(
    "mutation_matrix",
    with_views("fx_variants", "SELECT DISTINCT regexp_extract(tumor_sample_barcode, 'TCGA-[A-Z0-9]+-[A-Z0-9]+-01') AS sample, hugo_symbol AS feature, 1.0::DOUBLE AS value FROM fx_variants "
               "WHERE variant_classification IN (" + ", ".join(f"'{c}'" for c in matrix.MUTATION_CLASSES) + ") AND regexp_matches(tumor_sample_barcode, 'TCGA-[A-Z0-9]+-[A-Z0-9]+-01')"),
)
def mutation_matrix(spark, sf_dir):
    return matrix.mutation_matrix(view(spark, sf_dir, "fx_variants"))


@query(
    "methylation_gene_matrix",
    with_views("fx_matrix_sparse fx_probe_map", "+g AS (SELECT sample, gene AS feature, AVG(value) AS value FROM fx_matrix_sparse JOIN fx_probe_map ON feature = probe WHERE gene <> '.' GROUP BY 1, 2), "
               "kept AS (SELECT feature FROM g GROUP BY 1 HAVING COUNT(*) FILTER (value = 0) < (SELECT FLOOR(0.2 * COUNT(DISTINCT sample)) FROM g)) "
               "SELECT sample, feature, ROUND(value, 6) AS value FROM g WHERE feature IN (SELECT feature FROM kept)"),
)
def methylation_gene_matrix(spark, sf_dir):
    genes = matrix.methylation_gene_matrix(view(spark, sf_dir, "fx_matrix_sparse"), view(spark, sf_dir, "fx_probe_map"))
    return matrix.filter_feature_by_zero_count(genes).withColumn("value", F.round("value", 6))


@query("check_key_alignment", with_views("fx_survival fx_scores", "SELECT COUNT(*) FILTER (b.run_id IS NULL) AS left_only, COUNT(*) FILTER (a.sample IS NULL) AS right_only, "
       "COUNT(*) FILTER (a.sample IS NOT NULL AND b.run_id IS NOT NULL) AS matched FROM (SELECT DISTINCT sample FROM fx_survival) a FULL JOIN (SELECT DISTINCT run_id FROM fx_scores) b ON a.sample = b.run_id"))
def check_key_alignment(spark, sf_dir):
    right = view(spark, sf_dir, "fx_scores").select(F.col("run_id").alias("sample"))
    return stats.key_alignment(view(spark, sf_dir, "fx_survival"), right, "sample")
