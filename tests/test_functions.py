"""Distribution tails against published values, and column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dist, scalar


def test_tails_at_known_points():
    assert dist.chi2_sf([3.841458820694124, 5.991464547107979], [1, 2]) == pytest.approx([0.05, 0.05], abs=1e-12)
    assert dist.chi2_sf([0.0, 40.0], [1, 3]) == pytest.approx([1.0, 1.0655e-8], rel=1e-3)
    assert dist.t_sf2([2.2281388519649385, 12.706204736432095], [10, 1]) == pytest.approx([0.05, 0.05], abs=1e-10)
    assert dist.f_sf([4.9646027437307145], [1], [10]) == pytest.approx([0.05], abs=1e-10)
    assert dist.normal_sf2([1.959963984540054, -1.959963984540054, 0.0]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-12)


def test_gamma_family():
    x = np.array([0.3, 1.0, 4.5, 30.0])
    import math

    assert dist.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-11)
    step = 1e-5
    slope = (dist.log_gamma(x + step) - dist.log_gamma(x - step)) / (2 * step)
    assert dist.digamma(x) == pytest.approx(slope, abs=1e-6)
    curve = (dist.digamma(x + step) - dist.digamma(x - step)) / (2 * step)
    assert dist.trigamma(x) == pytest.approx(curve, rel=1e-6)


def test_p_values_of_null_are_null(spark):
    df = spark.createDataFrame([(1.0, 4.0), (None, 4.0)], "t double, df double")
    assert [r.p is None for r in df.select(dist.t_p("t", "df").alias("p")).collect()] == [False, True]


def test_text_or_list(spark):
    df = spark.createDataFrame([('["1A","2B"]',), ('"3C"',), ("4D",), ('["5E"]',), (None,)], "raw string")
    text, count = scalar.text_or_list(F.col("raw"))
    rows = [tuple(r) for r in df.select(text.alias("t"), count.alias("n")).collect()]
    assert rows == [("1A;2B", 2), ("3C", 1), ("4D", 1), ("5E", 1), (None, None)]


def test_barcode_functions(spark):
    df = spark.createDataFrame([("TCGA-AB-1234-01A-11D-A000-08",), ("TCGA-AB-1234-11A",), ("x",)], "b string")
    b = F.col("b")
    rows = df.select(
        scalar.matched(b, scalar.PRIMARY_BARCODE).alias("m"), scalar.sample_type(b).alias("k"), scalar.barcode_parts(b, 4).alias("p")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("TCGA-AB-1234-01", "TP", "TCGA-AB-1234-01A"), (None, "NT", "TCGA-AB-1234-11A"), (None, None, "x"),
    ]


def test_small_text_functions(spark):
    row = spark.range(1).select(
        scalar.distinct_joined(F.lit("b;a;;b")).alias("joined"), scalar.bit_string(F.lit(5), 6).alias("bits"),
        scalar.floor_fraction(F.lit(14), 0.2).alias("part"), scalar.drop_last_char(F.lit("abc")).alias("short"),
        scalar.percent_text(F.lit(1), F.lit(0)).alias("none"), scalar.null_if_nan(F.lit(float("nan"))).alias("nan"),
    ).head()
    assert tuple(row) == ("a;b", "000101", 2, "ab", None, None)
