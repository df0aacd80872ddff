"""The long matrix: cohort choice, mutation and methylation matrices, reshaping, packing, quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import PRIMARY_BARCODE, drop_last_char, matched
from cohortloom.operators.lists import first_per_key
from cohortloom.operators.ordered import numbered, quantiles, with_row
from cohortloom.runtime import has_at_most

# The variant classes that count as a mutation of the gene.
MUTATION_CLASSES = ["Nonsense_Mutation", "Missense_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site"]
MODALITIES = ["Mut", "Cnv", "Rna", "miRna", "Meth", "Protein"]
WHOLE_COHORT = ("PAN", "PANCAN")

MAX_PIVOT_COLUMNS = 10_000


def cohort_select(header: DataFrame, basic: DataFrame, dense: DataFrame, cohort: str) -> DataFrame:
    """Distinct primary-tumour samples of a cohort that the matrix header holds.

    Barcodes of ``basic`` are made unique before their last character goes, so two aliquots may share a sample.
    """
    typed = first_per_key(
        basic.where(F.col("program") == "TCGA").select("sample", "sample_type", "project_id"),
        ["sample"],
        ["sample_type", "project_id"],
    ).select(drop_last_char(F.col("sample")).alias("sample"), F.col("sample_type").alias("type_y"), "project_id")
    joined = dense.select("sample").join(typed, "sample", "left").where(F.col("project_id").isNotNull())
    primary = joined.where(F.col("type_y") == "Primary Tumor")
    if cohort not in WHOLE_COHORT:
        primary = primary.where(F.col("project_id") == f"TCGA-{cohort}")
    return header.select("sample").distinct().join(primary, "sample", "left_semi")


def mutation_matrix(variants: DataFrame, per_aliquot: bool = False) -> DataFrame:
    """(sample, feature, 1.0) of genes with a counted variant in a primary tumour; absent pairs mean 0."""
    counted = variants.where(
        F.col("variant_classification").isin(MUTATION_CLASSES) & F.col("tumor_sample_barcode").rlike(PRIMARY_BARCODE)
    )
    key = F.col("tumor_sample_barcode") if per_aliquot else matched(F.col("tumor_sample_barcode"), PRIMARY_BARCODE)
    pairs = counted.select(key.alias("sample"), F.col("hugo_symbol").alias("feature")).distinct()
    return pairs.withColumn("value", F.lit(1.0))


def methylation_gene_matrix(matrix: DataFrame, probes: DataFrame) -> DataFrame:
    """Mean over the probes of each gene, for every sample; probes without a gene are left out."""
    mapped = matrix.join(probes, F.col("feature") == F.col("probe"), "left").where(F.col("gene") != ".")
    return mapped.groupBy("sample", F.col("gene").alias("feature")).agg(F.avg("value").alias("value"))


def to_wide(long: DataFrame, rows: str, columns: str, value: str, names: list | None = None, fill=None) -> DataFrame:
    """One column per value of ``columns``. Names are looked up if not given, and must be few enough for a plan."""
    if names is None:
        distinct = long.select(columns).distinct()
        if not has_at_most(distinct, MAX_PIVOT_COLUMNS):
            raise ValueError(f"more than {MAX_PIVOT_COLUMNS} columns: stay with the long form")
        names = [row[0] for row in distinct.orderBy(columns).collect()]
    wide = long.groupBy(rows).pivot(columns, names).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.fillna(fill, subset=[str(n) for n in names])


def prefixed(matrix: DataFrame, prefix: Column | str) -> DataFrame:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return matrix.withColumn("feature", F.concat(head, F.col("feature")))


def suffixed(matrix: DataFrame, suffix: Column | str) -> DataFrame:
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    return matrix.withColumn("feature", F.concat(F.col("feature"), tail))


def sample_counts(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Samples per modality (or overall): the N of every ratio rule, because missing cells are absent rows."""
    return matrix.groupBy(*keys).agg(F.countDistinct("sample").alias("n_samples"))


def _feature_stats(matrix: DataFrame, keys: list[str]) -> DataFrame:
    stats = matrix.groupBy(*keys, "feature").agg(
        F.count("value").alias("n_present"),
        F.count(F.when(F.col("value") == 0, 1)).alias("n_zero"),
        F.avg("value").alias("mean"),
    )
    counts = sample_counts(matrix, keys)
    return stats.join(counts, keys) if keys else with_row(stats, counts)


def _keys_of(matrix: DataFrame) -> list[str]:
    return ["modality"] if "modality" in matrix.columns else []


def filter_feature_by_zero_count(matrix: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Keep features with fewer zeros than the whole part of ``ratio`` times the samples; a null is not a zero."""
    keys = _keys_of(matrix)
    kept = _feature_stats(matrix, keys).where(F.col("n_zero") < F.floor(F.lit(ratio) * F.col("n_samples")))
    return matrix.join(kept.select(*keys, "feature"), [*keys, "feature"], "left_semi")


def filter_feature_by_null_ratio(matrix: DataFrame, max_ratio: float = 0.8) -> DataFrame:
    """Keep features whose share of missing cells is below ``max_ratio``."""
    keys = _keys_of(matrix)
    share = 1 - F.col("n_present") / F.col("n_samples")
    kept = _feature_stats(matrix, keys).where(share < max_ratio)
    return matrix.join(kept.select(*keys, "feature"), [*keys, "feature"], "left_semi")


def filter_feature_by_mean_quantile(matrix: DataFrame, probability: float = 0.25) -> DataFrame:
    """Keep features whose mean over samples is above the quantile of all feature means."""
    means = matrix.groupBy("feature").agg(F.avg("value").alias("mean"))
    limit = quantiles(means, [], "mean", {"limit": probability})
    kept = with_row(means, limit).where(F.col("mean") > F.col("limit")).select("feature")
    return matrix.join(kept, "feature", "left_semi")


def complete_samples(matrix: DataFrame, n_modalities: int) -> DataFrame:
    """Rows of samples present in all modalities: the n-way inner join without a join per modality."""
    whole = (
        matrix.select("sample", "modality")
        .distinct()
        .groupBy("sample")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == n_modalities)
    )
    return matrix.join(whole.select("sample"), "sample", "left_semi")


def region_counts(members: DataFrame, n_sets: int, item: str = "item", set_no: str = "set_no") -> DataFrame:
    """Size of every exclusive region of ``n_sets`` sets; bit i from the left stands for set i.

    Each item becomes one bit mask, so an item in many sets is one row after the partial aggregate.
    """
    bit = F.expr(f"shiftleft(1, {n_sets - 1} - cast({set_no} as int))")
    masks = members.groupBy(item).agg(F.bit_or(bit).alias("mask"))
    sizes = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    spark = members.sparkSession
    every = spark.range(1, 2**n_sets).select(F.col("id").cast("int").alias("mask"))
    filled = every.join(sizes, "mask", "left").select("mask", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("union_size"))
    return with_row(filled, total).select(F.lpad(F.bin("mask"), n_sets, "0").alias("region"), "n", "union_size")


def region_labels(regions: DataFrame, fill: list[str]) -> DataFrame:
    """Label text in the fixed order logic, number, percent."""
    parts = []
    if "logic" in fill:
        parts.append(F.concat("region", F.lit(": ")))
    if "number" in fill:
        parts.append(F.col("n").cast("string"))
    if "percent" in fill:
        share = F.when(F.col("union_size") > 0, 100.0 * F.col("n") / F.nullif(F.col("union_size"), F.lit(0)))
        parts.append(F.when(share.isNotNull(), F.format_string("(%.1f%%)", share)).otherwise(""))
    return regions.withColumn("label", F.concat(*parts) if parts else F.lit(""))


def feature_index(matrix: DataFrame) -> DataFrame:
    """(feature, position) with positions from 0 by feature name."""
    names = matrix.select("feature").distinct()
    return numbered(names, [], ["feature"], "position").withColumn("position", (F.col("position") - 1).cast("int"))


def sample_rows(matrix: DataFrame, index: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per sample: positions and values of its present cells, in position order."""
    cells = matrix.join(index, "feature").where(F.col("value").isNotNull())
    packed = cells.groupBy("sample", *(extra or [])).agg(
        F.sort_array(F.collect_list(F.struct("position", "value"))).alias("cells")
    )
    return packed.select(
        "sample", *(extra or []), F.col("cells.position").alias("positions"), F.col("cells.value").alias("cell_values")
    )
