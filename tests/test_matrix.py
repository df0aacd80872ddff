"""The long matrix, set regions and quality filters."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import impute, matrix


def test_region_counts_of_overlapping_sets(spark):
    """Multiples of 2, 3 and 5 up to 30: the regions were counted by hand."""
    members = spark.createDataFrame([(i, at) for at, step in enumerate((2, 3, 5)) for i in range(step, 31, step)], "item int, set_no int")
    regions = matrix.region_counts(members, 3)
    # 30 lies in all; 6, 12, 18, 24; 10, 20; 15; then 2, 4, 8, 14, 16, 22, 26, 28; 3, 9, 21, 27; 5, 25.
    assert {r.region: r.n for r in regions.collect()} == {"111": 1, "110": 4, "101": 2, "011": 1, "100": 8, "010": 4, "001": 2}
    labels = {r.region: r.label for r in matrix.region_labels(regions, ["percent", "number", "logic"]).collect()}
    assert labels["100"] == "100: 8(36.4%)"
    assert {r.label for r in matrix.region_labels(regions, ["number"]).where("region = '010'").collect()} == {"4"}


def test_empty_union_has_no_percent(spark):
    empty = spark.createDataFrame([], "item int, set_no int")
    rows = matrix.region_labels(matrix.region_counts(empty, 2), ["number", "percent"]).collect()
    assert [r.label for r in rows] == ["0", "0", "0"]


def test_zero_rule_is_strict_and_ignores_missing(spark):
    cells = [(f"s{i}", "two_zeros", 0.0 if i < 2 else 1.0) for i in range(10)]
    cells += [(f"s{i}", "one_zero", 0.0 if i < 1 else 1.0) for i in range(10)]
    cells += [(f"s{i}", "mostly_missing", 1.0) for i in range(2)]
    df = spark.createDataFrame(cells, "sample string, feature string, value double")
    kept = matrix.filter_feature_by_zero_count(df).select("feature").distinct()
    assert {r.feature for r in kept.collect()} == {"one_zero", "mostly_missing"}
    present = matrix.filter_feature_by_null_ratio(df).select("feature").distinct()
    assert {r.feature for r in present.collect()} == {"two_zeros", "one_zero"}


def test_four_samples_keep_nothing_under_the_zero_rule(spark):
    df = spark.createDataFrame([(f"s{i}", "f", 1.0) for i in range(4)], "sample string, feature string, value double")
    assert matrix.filter_feature_by_zero_count(df).isEmpty()


def test_cohort_fans_out_over_aliquots_and_needs_primary_type(spark):
    basic = spark.createDataFrame(
        [("T-1-01A", "TCGA", "Primary Tumor", "TCGA-X"), ("T-1-01B", "TCGA", "Primary Tumor", "TCGA-X"), ("T-2-11A", "TCGA", "Solid Tissue Normal", "TCGA-X"),
         ("T-3-01A", "OTHER", "Primary Tumor", "TCGA-X"), ("T-4-01A", "TCGA", "Primary Tumor", None), ("T-5-01A", "TCGA", "Primary Tumor", "TCGA-Y")],
        "sample string, program string, sample_type string, project_id string",
    )
    names = ["T-1-01", "T-2-11", "T-3-01", "T-4-01", "T-5-01", "T-9-01"]
    dense = spark.createDataFrame([(n,) for n in names], "sample string")
    assert [r[0] for r in matrix.cohort_select(dense, basic, dense, "X").collect()] == ["T-1-01"]
    assert {r[0] for r in matrix.cohort_select(dense, basic, dense, "PAN").collect()} == {"T-1-01", "T-5-01"}


def test_two_aliquots_of_a_sample_are_one_row(spark):
    variants = spark.createDataFrame(
        [("TCGA-A-B-01A-1", "g", "Missense_Mutation"), ("TCGA-A-B-01B-2", "g", "Splice_Site"), ("TCGA-A-B-11A-2", "h", "Splice_Site"), ("TCGA-A-C-01A-2", "h", "Silent")],
        "tumor_sample_barcode string, hugo_symbol string, variant_classification string",
    )
    assert [tuple(r) for r in matrix.mutation_matrix(variants).collect()] == [("TCGA-A-B-01", "g", 1.0)]
    assert matrix.mutation_matrix(variants, per_aliquot=True).count() == 2


def test_probe_mean_leaves_out_unmapped_probes(spark):
    m = spark.createDataFrame([("s", "p1", 1.0), ("s", "p2", 3.0), ("s", "p3", 9.0), ("s", "p4", 7.0)], "sample string, feature string, value double")
    probes = spark.createDataFrame([("p1", "g"), ("p2", "g"), ("p3", "."), ("p4", None)], "probe string, gene string")
    assert [tuple(r) for r in matrix.methylation_gene_matrix(m, probes).collect()] == [("s", "g", 2.0)]


def test_wide_form_refuses_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MAX_PIVOT_COLUMNS", 3)
    df = spark.range(5).select(F.lit("r").alias("row"), F.col("id").alias("c"), F.col("id").alias("v"))
    with pytest.raises(ValueError):
        matrix.to_wide(df, "row", "c", "v")


def test_fill_missing_gives_every_cell_a_value(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "sample string, feature string, value double")
    assert sorted(tuple(r) for r in impute.fill_missing(m).collect()) == [("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.0), ("b", "y", 2.0)]
