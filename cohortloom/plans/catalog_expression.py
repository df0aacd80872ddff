"""Queries for counts, differential tests, consensus and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalar
from cohortloom.operators import annotate, counts, diffexp, edger, filtering, nbtest, sva
from cohortloom.plans.registry import query
from cohortloom.plans.views import table, view, with_views
from cohortloom.runtime import materialize

_NORM = """+q AS (SELECT sample, quantile_cont(cnt, 0.75) AS uq FROM fx_counts WHERE cnt > 0 GROUP BY 1), c AS (SELECT EXP(AVG(LN(uq))) AS common FROM q) """


@query("norm_counts", with_views("fx_counts", _NORM + "SELECT gene, f.sample, ROUND(cnt / uq * common, 6) AS value FROM fx_counts f JOIN q ON f.sample = q.sample, c"))
def norm_counts(spark, sf_dir):
    return counts.norm_counts(view(spark, sf_dir, "fx_counts")).withColumn("value", F.round("value", 6))


_KINDS = """+i AS (SELECT p_brand || '|' || p_type AS gene, CAST(SUM(p_size) AS DOUBLE) AS measure FROM part GROUP BY 1),
    e AS (SELECT quantile_cont(measure, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM i),
    k AS (SELECT gene, len(list_filter(edges, lambda x: x < measure)) AS stratum FROM i, e),
    p AS (SELECT * FROM fx_counts JOIN k USING (gene)), w AS (SELECT sample, quantile_cont(cnt, 0.75) AS whole FROM p WHERE cnt > 0 GROUP BY 1),
    u AS (SELECT sample, stratum, quantile_cont(cnt, 0.75) AS part FROM p WHERE cnt > 0 GROUP BY 1, 2),
    f AS (SELECT gene, sample, cnt / part * whole AS cnt FROM p JOIN u USING (sample, stratum) JOIN w USING (sample)),
    q AS (SELECT sample, quantile_cont(cnt, 0.75) AS uq FROM f WHERE cnt > 0 GROUP BY 1), c AS (SELECT EXP(AVG(LN(uq))) AS common FROM q) """


@query("norm_counts_within", with_views("fx_counts", _KINDS + "SELECT gene, f.sample, ROUND(cnt / uq * common, 6) AS value FROM f JOIN q ON f.sample = q.sample, c"))
def norm_counts_within(spark, sf_dir):
    """Normalized within samples by ten strata of a measure of the gene first, then between samples."""
    info = table(spark, sf_dir, "part").groupBy(F.concat_ws("|", "p_brand", "p_type").alias("gene")).agg(F.sum("p_size").cast("double").alias("measure"))
    return counts.norm_counts(view(spark, sf_dir, "fx_counts"), info).withColumn("value", F.round("value", 6))


_FACTORS = """+g AS (SELECT gene, AVG(LN(cnt)) AS center FROM fx_counts WHERE cnt > 0 GROUP BY 1 HAVING COUNT(*) = (SELECT COUNT(DISTINCT sample) FROM fx_counts)),
    sf AS (SELECT sample, EXP(quantile_cont(LN(cnt) - center, 0.5)) AS size_factor FROM fx_counts JOIN g USING (gene) WHERE cnt > 0 GROUP BY 1) """


@query("deseq_size_factors", with_views("fx_counts", _FACTORS + "SELECT sample, ROUND(size_factor, 6) AS size_factor FROM sf"))
def deseq_size_factors(spark, sf_dir):
    return counts.size_factors(view(spark, sf_dir, "fx_counts")).withColumn("size_factor", F.round("size_factor", 6))


def _design(df):
    return df.select("sample", "grp").distinct()


@query("deseq_wald")
def deseq_wald(spark, sf_dir):
    """All genes of the two groups, Wald test, without the effect and significance cut."""
    df = view(spark, sf_dir, "fx_counts")
    return nbtest.nb_test(df, _design(df), "grp", "wald")


@query("deseq_base_mean", with_views("fx_counts", _FACTORS + "SELECT gene, ROUND(SUM(cnt / size_factor) / (SELECT COUNT(DISTINCT sample) FROM fx_counts), 6) AS base_mean FROM fx_counts JOIN sf USING (sample) GROUP BY 1"))
def deseq_base_mean(spark, sf_dir):
    """The mean of normalized counts of the Wald result, which SQL can check."""
    df = view(spark, sf_dir, "fx_counts")
    return nbtest.nb_test(df, _design(df), "grp", "wald").select("gene", F.round("base_mean", 6).alias("base_mean"))


@query("edger_lrt")
def edger_lrt(spark, sf_dir):
    """The second method: trimmed-mean factors, tagwise dispersions, likelihood-ratio test."""
    df = view(spark, sf_dir, "fx_counts")
    return nbtest.nb_test(df, _design(df), "grp", "edger")


_TMM = """+p AS (SELECT gene, sample, CAST(cnt AS DOUBLE) AS cnt FROM fx_counts WHERE cnt > 0), l AS (SELECT sample, SUM(cnt) AS lib FROM p GROUP BY 1),
    z AS (SELECT g.gene, l.sample, l.lib, COALESCE(p.cnt, 0) AS cnt FROM (SELECT DISTINCT gene FROM p) g CROSS JOIN l LEFT JOIN p ON p.gene = g.gene AND p.sample = l.sample),
    q AS (SELECT sample, lib, quantile_cont(cnt, 0.75) / lib AS uq FROM z GROUP BY 1, 2),
    b AS (SELECT sample AS rs, lib AS rl FROM q ORDER BY ROUND(ABS(uq - (SELECT AVG(uq) FROM q)), 12), sample LIMIT 1),
    r AS (SELECT p.sample, ROUND(LOG2((p.cnt / lib) / (o.cnt / rl)), 10) AS m, ROUND((LOG2(p.cnt / lib) + LOG2(o.cnt / rl)) / 2, 10) AS a,
                 (1 - p.cnt / lib) / p.cnt + (1 - o.cnt / rl) / o.cnt AS w FROM p JOIN l USING (sample), b JOIN p o ON o.sample = b.rs WHERE o.gene = p.gene),
    k AS (SELECT *, COUNT(*) OVER s AS n, MAX(ABS(m)) OVER s AS most, RANK() OVER (PARTITION BY sample ORDER BY m) + (COUNT(*) OVER (PARTITION BY sample, m) - 1) / 2 AS rm,
                 RANK() OVER (PARTITION BY sample ORDER BY a) + (COUNT(*) OVER (PARTITION BY sample, a) - 1) / 2 AS ra FROM r WINDOW s AS (PARTITION BY sample)),
    t AS (SELECT sample, SUM(m / w) / SUM(1 / w) AS f FROM k WHERE w > 0 AND most >= 1e-6 AND rm BETWEEN FLOOR(n * 0.3) + 1 AND n - FLOOR(n * 0.3)
          AND ra BETWEEN FLOOR(n * 0.05) + 1 AND n - FLOOR(n * 0.05) GROUP BY 1),
    v AS (SELECT l.sample, lib, COALESCE(f, 0) AS f FROM l LEFT JOIN t USING (sample)) """


@query("tmm_factors", with_views("fx_counts", _TMM + "SELECT sample, lib AS lib_size, ROUND(POWER(2, f - (SELECT AVG(f) FROM v)), 6) AS norm_factor FROM v"))
def tmm_factors(spark, sf_dir):
    """Doubly trimmed weighted means of log ratios to a reference sample."""
    return edger.tmm_factors(view(spark, sf_dir, "fx_counts")).withColumn("norm_factor", F.round("norm_factor", 6))


_NEAR = """+g AS (SELECT grp AS run, gene, AVG(cnt) AS base_mean, SUM(cnt) AS total FROM fx_counts GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY base_mean, gene) AS rn, COUNT(*) OVER (PARTITION BY run) AS n FROM g),
    h AS (SELECT *, FLOOR(FLOOR(CASE WHEN n > 10 THEN POWER(10 / n, 0.23) ELSE 1 END * n) / 2)::BIGINT AS half FROM r) """


@query("edger_near_genes", with_views("fx_counts", _NEAR + "SELECT a.run, a.gene, ROUND(AVG(b.total), 4) AS near_0, ROUND(AVG(10.0 * b.total), 4) AS near_9 FROM h a JOIN h b ON a.run = b.run AND b.rn BETWEEN a.rn - a.half AND a.rn + a.half GROUP BY 1, 2"))
def edger_near_genes(spark, sf_dir):
    """The moving average over genes of near abundance that tagwise dispersions lean on, of multiples of the counts."""
    total = F.sum("cnt")
    grids = view(spark, sf_dir, "fx_counts").groupBy(F.col("grp").cast("int").alias("run"), "gene").agg(
        F.avg("cnt").alias("base_mean"), *[(total * (i + 1)).cast("double").alias(f"l{i}") for i in range(len(edger.GRID))]
    )
    return edger.near_genes(grids).select(F.col("run").cast("long").alias("run"), "gene", F.round("s0", 4).alias("near_0"), F.round("s9", 4).alias("near_9"))


@query("deseq_outliers")
def deseq_outliers(spark, sf_dir):
    """Counts that the Wald test replaces, and genes whose p-value it withholds."""
    df = view(spark, sf_dir, "fx_counts")
    return nbtest.outliers(df, _design(df), "grp")


_REJECTED = """+b AS (SELECT gene, CAST(SUM(cnt) AS DOUBLE) AS base FROM fx_counts GROUP BY 1), d AS (SELECT run_id, pvalue, base FROM fx_deg JOIN b USING (gene)),
    c AS (SELECT run_id, unnest(range(50)) AS cut, unnest(quantile_cont(base, [%s])) AS cutoff FROM d GROUP BY 1),
    k AS (SELECT d.run_id, cut, pvalue FROM d JOIN c ON d.run_id = c.run_id AND base >= cutoff),
    r AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id, cut) AS m, RANK() OVER (PARTITION BY run_id, cut ORDER BY pvalue) + COUNT(*) OVER (PARTITION BY run_id, cut, pvalue) - 1 AS i FROM k),
    a AS (SELECT run_id, cut, MIN(LEAST(1.0, pvalue * m / i)) OVER (PARTITION BY run_id, cut ORDER BY pvalue DESC) AS padj FROM r) """ % ", ".join(
    repr(filtering.TOP * (i / (filtering.CUTS - 1))) for i in range(filtering.CUTS)
)


@query("filter_rejections", with_views("fx_deg fx_counts", _REJECTED + "SELECT run_id, cut::INTEGER AS cut, COUNT(*) AS n FROM a WHERE padj < 0.97 GROUP BY 1, 2"))
def filter_rejections(spark, sf_dir):
    """Rejections behind each of fifty cuts on the genes' counts, for all runs in one pass."""
    base = view(spark, sf_dir, "fx_counts").groupBy("gene").agg(F.sum("cnt").cast("double").alias("base"))
    return filtering.rejections(materialize(view(spark, sf_dir, "fx_deg").join(base, "gene"), "deg"), "pvalue", "base", ["run_id"], 0.97)


@query("deseq_tumor_normal")
def deseq_tumor_normal(spark, sf_dir):
    """Tumour against normal tissue by barcode type, cut at p below 0.1 and any effect; centre and type together are the samples."""
    barcode = F.col("tumor_sample_barcode")
    variants = view(spark, sf_dir, "fx_variants")
    cells = variants.select(
        F.concat(scalar.barcode_part(barcode, 2), F.lit("-"), scalar.sample_type(barcode)).alias("sample"),
        scalar.sample_type(barcode).alias("kind"),
        F.col("hugo_symbol").alias("gene"),
    )
    table_ = cells.groupBy("sample", "kind", "gene").agg(F.count(F.lit(1)).alias("cnt"))
    design = table_.select("sample", F.when(F.col("kind") == "TP", 1).otherwise(0).alias("grp")).distinct()
    return diffexp.two_sided_effect(nbtest.nb_test(table_, design, "grp", "wald"), 0.0, 0.1, p="pvalue")


@query("sva_batch")
def sva_batch(spark, sf_dir):
    df = view(spark, sf_dir, "fx_counts")
    return sva.hidden_covariates(df, _design(df), "grp", 2)


_BH = """+r AS (SELECT run_id, gene, log2fc, pvalue, COUNT(*) OVER (PARTITION BY run_id) AS m, RANK() OVER (PARTITION BY run_id ORDER BY pvalue) + COUNT(*) OVER (PARTITION BY run_id, pvalue) - 1 AS i FROM fx_deg),
    a AS (SELECT run_id, gene, log2fc, MIN(LEAST(1.0, pvalue * m / i)) OVER (PARTITION BY run_id ORDER BY pvalue DESC) AS padj FROM r) """


@query("classify_volcano", with_views("fx_deg", _BH + """SELECT run_id, gene, CASE WHEN ABS(log2fc) > 1.5 AND padj < 0.05 THEN 'FC and P' WHEN ABS(log2fc) > 1.5 THEN 'FC'
    WHEN padj < 0.05 THEN 'P' ELSE 'NS' END AS volcano FROM a"""))
def classify_volcano(spark, sf_dir):
    adjusted = diffexp.fdr_bh(view(spark, sf_dir, "fx_deg"), "pvalue", ["run_id"])
    return diffexp.volcano_class(adjusted).select("run_id", "gene", "volcano")


_CUT = "+cut AS (SELECT * FROM fx_deg WHERE ABS(log2fc) >= 0.5 AND pvalue < 0.5) "


@query("deg_consensus", with_views("fx_deg", _CUT + "SELECT gene, ROUND(100.0 * COUNT(log2fc) / 10, 10) AS present_percent, ROUND(MEDIAN(log2fc), 10) AS log2fc_median, ROUND(AVG(log2fc), 10) AS log2fc_mean FROM cut GROUP BY 1"))
def deg_consensus(spark, sf_dir):
    cut = diffexp.two_sided_effect(view(spark, sf_dir, "fx_deg"), 0.5, 0.5, p="pvalue")
    result = diffexp.consensus(cut, 10)
    return result.select("gene", *[F.round(c, 10).alias(c) for c in ("present_percent", "log2fc_median", "log2fc_mean")])


@query("drug_interactions", with_views("fx_interactions", """+i AS (SELECT gene, partner, score, array_to_string(list_sort(list(DISTINCT interaction_type)), '&') AS types FROM fx_interactions GROUP BY 1, 2, 3),
    c AS (SELECT gene, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT gene, category FROM fx_interactions) GROUP BY 1)
    SELECT gene, categories, string_agg(partner || ';' || score || '.0;' || types, '&' ORDER BY partner, score) AS interactions_text, COUNT(*)::INTEGER AS n_interactions FROM i JOIN c USING (gene) GROUP BY 1, 2"""))
def drug_interactions(spark, sf_dir):
    terms = annotate.nested_terms(view(spark, sf_dir, "fx_interactions"))
    return annotate.drug_interactions(terms).drop("interactions_list")


@query("structure_ids", with_views("fx_links", """+r AS (SELECT * FROM fx_links WHERE reviewed = 'reviewed'), d AS (SELECT DISTINCT gene, id FROM (SELECT gene, unnest(string_split(COALESCE(pdb, ''), ';')) AS id FROM r) WHERE id <> ''),
    e AS (SELECT gene, string_agg(entry, ';' ORDER BY entry) AS entries FROM r GROUP BY 1), p AS (SELECT gene, string_agg(id, ';' ORDER BY id) AS pdb_ids, COUNT(*)::INTEGER AS pdb_count FROM d GROUP BY 1)
    SELECT gene, 0 AS part, entries, COALESCE(pdb_ids, '') AS pdb_ids, COALESCE(pdb_count, 0) AS pdb_count FROM e LEFT JOIN p USING (gene)"""))
def structure_ids(spark, sf_dir):
    return annotate.structure_ids(view(spark, sf_dir, "fx_links"))


@query("oncogene_table", with_views("fx_oncogenes", 'SELECT gene, is_oncogene AS "OncoKB_Is Oncogene", is_tsg AS "OncoKB_Is Tumor Suppressor Gene", NULL::VARCHAR AS "OncoKB_Highest Level of Evidence(sensitivity)", NULL::VARCHAR AS "OncoKB_Highest Level of Evidence(resistance)", background AS "OncoKB_Background" FROM fx_oncogenes'))
def oncogene_table(spark, sf_dir):
    curated = view(spark, sf_dir, "fx_oncogenes").select("gene", "is_oncogene", "is_tsg", F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("r"), "background")
    return annotate.oncogene_table(curated.toDF(*annotate.CURATED_COLUMNS))


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat_ws("|", "p_brand", "p_type").alias("gene"), F.concat(F.lit("ENSG"), "p_partkey").alias("ensembl")
    )


_ATLAS = """(SELECT g.gene, CASE WHEN e IS NULL THEN '' ELSE 'https://www.proteinatlas.org/' || e || '-' || g.gene END AS atlas_url FROM (SELECT DISTINCT gene FROM fx_deg) g
    LEFT JOIN (SELECT p_brand || '|' || p_type AS gene, MIN('ENSG' || p_partkey) AS e FROM part GROUP BY 1) s ON g.gene = s.gene)"""


@query("protein_atlas_links", with_views("fx_deg", f"SELECT * FROM {_ATLAS}"))
def protein_atlas_links(spark, sf_dir):
    return annotate.atlas_links(view(spark, sf_dir, "fx_deg"), _symbols(spark, sf_dir))


_ANNOTATION = """+cut AS (SELECT * FROM fx_deg WHERE ABS(log2fc) >= 0.5 AND pvalue < 0.5), base AS (SELECT gene, COUNT(*) AS n_runs FROM cut GROUP BY 1),
    r AS (SELECT * FROM fx_links WHERE reviewed = 'reviewed'), s AS (SELECT gene, COUNT(DISTINCT entry) AS n_entries FROM r GROUP BY 1) """


@query("annotate_genes", with_views("fx_deg fx_links fx_oncogenes", _ANNOTATION + f"SELECT base.gene, n_runs, n_entries, is_oncogene, atlas_url FROM base LEFT JOIN s USING (gene) LEFT JOIN fx_oncogenes USING (gene) LEFT JOIN {_ATLAS} USING (gene)"))
def annotate_genes(spark, sf_dir):
    deg = view(spark, sf_dir, "fx_deg")
    base = diffexp.two_sided_effect(deg, 0.5, 0.5, p="pvalue").groupBy("gene").agg(F.count(F.lit(1)).alias("n_runs"))
    entries = view(spark, sf_dir, "fx_links").where("reviewed = 'reviewed'").groupBy("gene").agg(F.countDistinct("entry").alias("n_entries"))
    curated = view(spark, sf_dir, "fx_oncogenes").select("gene", "is_oncogene")
    return annotate.annotate_genes(base, [entries, curated, annotate.atlas_links(base, _symbols(spark, sf_dir))])


@query("join_left_chain", with_views("fx_deg fx_links fx_oncogenes", "SELECT d.run_id, d.gene, d.log2fc, o.is_oncogene, l.entry FROM fx_deg d LEFT JOIN fx_oncogenes o USING (gene) LEFT JOIN fx_links l USING (gene)"))
def join_left_chain(spark, sf_dir):
    """Every differential row with its curated flag and all its entries: repeated genes fan out."""
    deg = view(spark, sf_dir, "fx_deg").select("run_id", "gene", "log2fc")
    curated = view(spark, sf_dir, "fx_oncogenes").select("gene", "is_oncogene")
    return annotate.annotate_genes(deg, [curated, view(spark, sf_dir, "fx_links").select("gene", "entry")])
