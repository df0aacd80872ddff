"""Input views with the shape of the cohort tables, derived from the given tables.

The text is used by Spark and, for the check, by DuckDB, so it keeps to SQL both understand.
``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cohortloom.runtime import partitions_for

_BARCODE = (
    "'TCGA-' || LPAD(CAST(c_nationkey AS STRING), 2, '0') || '-' || LPAD(CAST(c_custkey AS STRING), 6, '0')"
)

VIEWS = {
    "fx_matrix": """
        SELECT 'S' || CAST(l_suppkey AS STRING) AS sample, p_brand || '|' || p_type AS feature,
               SUM(l_quantity) AS value
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    "fx_matrix6": """
        SELECT CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Mut' WHEN 'AO' THEN 'Cnv' WHEN 'NF' THEN 'Rna'
                    WHEN 'NO' THEN 'miRna' WHEN 'RF' THEN 'Meth' ELSE 'Protein' END AS modality,
               'S' || CAST(l_suppkey AS STRING) AS sample, p_brand || '|' || p_type AS feature,
               SUM(l_quantity) AS value
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "fx_matrix_sparse": """
        SELECT 'S' || CAST(l_suppkey AS STRING) AS sample, 'P' || CAST(l_partkey AS STRING) AS feature,
               SUM(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) AS value
        FROM {lineitem} GROUP BY 1, 2""",
    "fx_sets": """
        SELECT DISTINCT l_orderkey AS item,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2
                    WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END AS set_no
        FROM {lineitem}""",
    "fx_phenotype": f"""
        SELECT {_BARCODE} || CASE WHEN c_custkey % 10 < 8 THEN '-01A' ELSE '-11A' END AS sample,
               CASE WHEN c_custkey % 17 = 0 THEN 'OTHER' ELSE 'TCGA' END AS program,
               CASE WHEN c_custkey % 10 < 8 THEN 'Primary Tumor' ELSE 'Solid Tissue Normal' END AS sample_type,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'TCGA-' || SUBSTRING(c_mktsegment, 1, 4) END AS project_id
        FROM {{customer}}""",
    "fx_variants": f"""
        SELECT {_BARCODE} || CASE WHEN c_custkey % 10 < 8 THEN '-01A-11D-A000-08' ELSE '-11A-11D-A000-08' END
                   AS tumor_sample_barcode,
               p_brand || '|' || p_type AS hugo_symbol,
               CASE l_linenumber WHEN 1 THEN 'Missense_Mutation' WHEN 2 THEN 'Nonsense_Mutation' WHEN 3 THEN 'Silent'
                    WHEN 4 THEN 'Frame_Shift_Del' WHEN 5 THEN 'Frame_Shift_Ins' WHEN 6 THEN 'Intron'
                    ELSE 'Splice_Site' END AS variant_classification
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
             JOIN {{customer}} ON o_custkey = c_custkey JOIN {{part}} ON l_partkey = p_partkey""",
    "fx_survival": """
        SELECT o_orderkey AS sample, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS os,
               CAST((YEAR(o_orderdate) - 1995) * 372 + (MONTH(o_orderdate) - 1) * 31 + DAY(o_orderdate) AS BIGINT) AS os_time,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS grp
        FROM {orders}""",
    "fx_cox": """
        SELECT o_orderkey AS sample, 'Feature' || CAST(l_linenumber AS STRING) AS feature, MAX(l_quantity) AS x,
               MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS os,
               CAST(MAX((YEAR(o_orderdate) - 1995) * 372 + (MONTH(o_orderdate) - 1) * 31 + DAY(o_orderdate)) AS BIGINT) AS os_time
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "fx_counts": """
        SELECT l_suppkey % 20 AS sample, l_suppkey % 2 AS grp, p_brand || '|' || p_type AS gene,
               CAST(SUM(l_quantity) AS BIGINT) AS cnt
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "fx_deg": """
        SELECT l_suppkey % 10 AS run_id, p_brand || '|' || p_type AS gene,
               ROUND(LOG2((SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) + 1e0)
                        / (SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) + 1e0)), 6) AS log2fc,
               CAST(MOD(SUM(l_partkey * 7919 + l_orderkey), 10007) AS DOUBLE) / 10007e0 AS pvalue
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    "fx_scores": """
        SELECT l_orderkey AS run_id, ROUND(MIN(l_tax), 2) AS log_rank_p, ROUND(MAX(l_tax) / 2, 3) AS tmb_p,
               ROUND(MAX(l_discount), 2) AS silhouette, MAX(l_quantity) AS rna_anova, MIN(l_quantity) AS rna_rf,
               MAX(l_suppkey) AS mirna_anova, MIN(l_suppkey) AS mirna_rf,
               ROUND(MAX(l_extendedprice), 2) AS meth_anova, ROUND(MIN(l_extendedprice), 2) AS meth_rf
        FROM {lineitem} GROUP BY 1""",
    "fx_probe_map": """
        SELECT 'P' || CAST(p_partkey AS STRING) AS probe,
               CASE WHEN p_partkey % 11 = 0 THEN '.' WHEN p_partkey % 23 = 0 THEN NULL
                    ELSE p_brand || '|' || p_type END AS gene
        FROM {part}""",
    "fx_tmb": """
        SELECT 'TCGA-' || LPAD(CAST(c_nationkey AS STRING), 2, '0') || '-' || LPAD(CAST(c_custkey AS STRING), 6, '0')
                   AS patient,
               c_custkey % 2 AS grp, COUNT(l_orderkey) AS n_variants
        FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey LEFT JOIN {lineitem} ON l_orderkey = o_orderkey
        GROUP BY 1, 2""",
    "fx_interactions": """
        SELECT DISTINCT p_brand AS gene, p_type AS category, s_name AS partner, l_linenumber AS score,
               l_returnflag AS interaction_type
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "fx_cells": "SELECT vec_id AS sample, label, label % 2 AS grp, embedding FROM {embeddings}",
    "fx_sample_survival": """
        SELECT 'S' || CAST(l_suppkey AS STRING) AS sample,
               CASE WHEN MOD(SUM(l_partkey), 3) = 0 THEN 0 ELSE 1 END AS os,
               CAST(MOD(SUM(l_orderkey), 3000) + 1 AS BIGINT) AS os_time
        FROM {lineitem} GROUP BY 1""",
    "fx_sample_burden": """
        SELECT 'S' || CAST(l_suppkey AS STRING) AS sample,
               LOG2(SUM(CASE WHEN l_linenumber IN (1, 2, 4, 5, 7) THEN 1 ELSE 0 END) / 38e0 + 1) AS total_per_mb_log
        FROM {lineitem} GROUP BY 1""",
    "fx_run_groups": """
        SELECT DISTINCT l_linenumber AS run_id, l_suppkey % 20 AS sample,
               CASE WHEN (l_suppkey % 20 + l_linenumber) % 4 < 2 THEN 0 ELSE 1 END AS grp
        FROM {lineitem}""",
    "fx_links": """
        SELECT p_brand || '|' || p_type AS gene, 'E' || CAST(p_partkey AS STRING) AS entry,
               CASE WHEN p_size % 3 = 0 THEN 'unreviewed' ELSE 'reviewed' END AS reviewed,
               CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN CAST(p_size AS STRING)
                    ELSE CAST(p_size AS STRING) || ';' || CAST(p_size % 4 AS STRING) END AS pdb
        FROM {part}""",
    "fx_oncogenes": """
        SELECT p_brand || '|' || p_type AS gene, MAX(CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END) AS is_oncogene,
               MIN(CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END) AS is_tsg, MAX(p_name) AS background
        FROM {part} GROUP BY 1""",
}


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """The view's rows. ``dealt`` names a key for each of its tables: they are dealt by it into ``parts`` partitions, so that joins
    and groups by these keys stay inside partitions of bounded size."""
    tables = {t: table(spark, sf_dir, t) for t in tables_of(name)}
    if dealt:
        parts = parts or max(partitions_for(df) for df in tables.values())
        tables = {t: df.repartition(parts, dealt[t]) for t, df in tables.items()}
    return spark.sql(VIEWS[name], **tables)


def orders_view(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """A view over orders and their items, which has an order's rows in one partition."""
    return view(spark, sf_dir, name, {"orders": "o_orderkey", "lineitem": "l_orderkey"}, parts)


def plain_sql(name: str) -> str:
    """The view's text with plain table names."""
    return VIEWS[name].format(**{t: t for t in tables_of(name)})


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views, then ``body``; ``body`` may go on with more common table expressions."""
    heads = ", ".join(f"{name} AS ({plain_sql(name)})" for name in names.split())
    return f"WITH {heads}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"
