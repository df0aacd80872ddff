"""Per-feature statistics from one aggregate: scaling, two-sample and variance tests, mutation burden, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.dist import digamma_of, f_p, t_p
from cohortloom.functions.scalar import barcode_part, barcode_parts, drop_last_char, log2p1
from cohortloom.operators.ordered import numbered, running
from cohortloom.runtime import materialize

# Captured megabases, and the variant classes that change the protein.
CAPTURE_MB = 38
NONSYNONYMOUS = [
    "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site", "Translation_Start_Site", "Nonsense_Mutation",
    "Nonstop_Mutation", "In_Frame_Del", "In_Frame_Ins", "Missense_Mutation",
]


def _feature_keys(df: DataFrame) -> list[str]:
    return [k for k in ("modality", "feature") if k in df.columns]


def scale_standard(matrix: DataFrame) -> DataFrame:
    """Mean 0 and population standard deviation 1 per feature; a constant feature becomes 0; absent cells stay absent."""
    keys = _feature_keys(matrix)
    stats = matrix.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    std = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    scaled = matrix.join(stats, keys).withColumn("value", (F.col("value") - F.col("_mean")) / std)
    return scaled.select(*matrix.columns)


def scale_minmax(matrix: DataFrame) -> DataFrame:
    """Range 0 to 1 per feature; a constant feature becomes 0."""
    keys = _feature_keys(matrix)
    stats = matrix.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    width = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    scaled = matrix.join(stats, keys).withColumn("value", (F.col("value") - F.col("_low")) / width)
    return scaled.select(*matrix.columns)


def tmb_per_sample(variants: DataFrame, capture_mb: float = CAPTURE_MB) -> DataFrame:
    """Protein-changing variants per megabase of primary-tumour aliquots, and its log2(x + 1)."""
    counted = variants.where(F.col("variant_classification").isin(NONSYNONYMOUS)).groupBy("tumor_sample_barcode").agg(
        F.count(F.lit(1)).alias("total")
    )
    barcode = F.col("tumor_sample_barcode")
    return counted.where(barcode_part(barcode, 4) == "01A").select(
        drop_last_char(barcode_parts(barcode, 4)).alias("sample"),
        "total",
        (F.col("total") / F.lit(float(capture_mb))).alias("total_per_mb"),
        log2p1(F.col("total") / F.lit(float(capture_mb))).alias("total_per_mb_log"),
    )


def welch_t(df: DataFrame, value: str, group: str, keys: list[str] | None = None) -> DataFrame:
    """t, degrees of freedom and two-sided p between groups 0 and 1; null if a group is too small or does not vary."""
    keys = keys or []
    known = df.where(F.col(value).isNotNull())
    parts = []
    for g in (0, 1):
        cell = F.when(F.col(group) == g, F.col(value))
        parts += [F.count(cell).alias(f"n{g}"), F.avg(cell).alias(f"m{g}"), F.var_samp(cell).alias(f"v{g}")]
    stats = known.groupBy(*keys).agg(*parts)
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    whole = e0 + e1
    usable = (F.col("n0") > 1) & (F.col("n1") > 1) & (whole > 0)
    t = F.when(usable, (F.col("m0") - F.col("m1")) / F.sqrt(whole))
    df_ = F.when(usable, whole * whole / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1)))
    return stats.select(*keys, "n0", "n1", t.alias("t"), df_.alias("df")).withColumn("p", t_p("t", "df"))


def anova_f(matrix: DataFrame, label: str) -> DataFrame:
    """F statistic and p per feature over the classes of ``label``; a constant feature has none."""
    cells = matrix.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    classes = cells.groupBy("feature", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")
    )
    return _f_of_classes(classes, ["feature"])


def anova_f_without_fold(matrix: DataFrame, label: str, dealt: DataFrame, folds: int) -> DataFrame:
    """F per (repeat, held, feature) on the samples outside fold ``held``, for all folds in one pass over the cells.

    Moments are taken once per fold and class; those of the other folds are merged, at most ``folds`` rows at a time.
    """
    cells = matrix.where(F.col("value").isNotNull()).join(dealt.select("sample", "repeat", "fold"), "sample")
    moments = cells.groupBy("feature", "repeat", "fold", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")
    )
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))
    spread = moments.withColumn("held", F.explode(others))
    keys = ["repeat", "held", "feature"]
    together = Window.partitionBy(*keys, label)
    centre = F.sum(F.col("n") * F.col("mean")).over(together) / F.sum("n").over(together)
    merged = spread.withColumn("centre", centre).groupBy(*keys, label).agg(
        F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("centre"), F.lit(2)))).alias("squares"),
        F.sum("n").alias("n"),
        F.max("centre").alias("mean"),
    )
    return _f_of_classes(merged.withColumn("var", F.col("squares") / F.col("n")).drop("squares"), keys)


def _f_of_classes(classes: DataFrame, keys: list[str]) -> DataFrame:
    """F, degrees of freedom and p from one row (n, mean, var) per key and class."""
    grand = classes.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    sums = classes.join(grand, keys).groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.max("groups").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    d1, d2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    usable = (d1 > 0) & (d2 > 0) & (F.col("within") > 0)
    f = F.when(usable, (F.col("between") / d1) / (F.col("within") / d2))
    return sums.select(*keys, f.alias("f"), d1.alias("d1"), d2.alias("d2")).withColumn(
        "p", f_p("f", F.col("d1").cast("double"), F.col("d2").cast("double"))
    )


def mutual_information(matrix: DataFrame, label: str, neighbours: int = 3) -> DataFrame:
    """Mutual information of each feature with the class, by nearest neighbours (Ross 2014), floored at 0.

    Row numbers within (feature, class) turn neighbours on the line into an equality join on the number; the count of
    points within the neighbour distance comes from running counts over the ordered values of the feature. So a feature
    is never gathered in one task.
    """
    cells = matrix.where(F.col("value").isNotNull()).select("sample", "feature", F.col(label).alias("label"), F.col("value").cast("double").alias("x"))
    placed = materialize(numbered(cells, ["feature", "label"], ["x", "sample"], "rn"), "mi-points")
    sizes = placed.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("nc"))
    points = placed.join(sizes, ["feature", "label"]).where("nc > 1").withColumn("k", F.least(F.lit(neighbours).cast("long"), F.col("nc") - 1))
    offsets = [i for i in range(-neighbours, neighbours + 1) if i]
    offered = placed.select("feature", "label", F.col("x").alias("near"), F.explode(F.array(*[F.col("rn") + o for o in offsets])).alias("rn"))
    distances = (
        points.join(offered, ["feature", "label", "rn"])
        .groupBy("feature", "label", "sample", "x", "nc", "k")
        .agg(F.sort_array(F.collect_list(F.struct(F.abs(F.col("near") - F.col("x")).alias("d"), "near"))).alias("ds"))
        .withColumn("far", F.element_at("ds", F.col("k").cast("int")))
    )
    # The interval ends at the neighbour's own value on its side, so rounding cannot move that point in or out.
    d, near = F.col("far.d"), F.col("far.near")
    ends = distances.select(
        "feature", "sample", "x", "nc", "k", (d == 0).alias("tied"),
        F.when(near < F.col("x"), near).otherwise(F.col("x") - d).alias("low"),
        F.when(near > F.col("x"), near).otherwise(F.col("x") + d).alias("high"),
    )
    queries = materialize(ends, "mi-queries")

    # Points of the kept classes and both ends of every interval in one order; only points count.
    values = queries.groupBy("feature", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(1))
    # Marks of kind 0 sit before the points of their value, kind 2 after them: open intervals, closed at distance 0.
    asked = queries.withColumns(
        {"low_kind": F.when(F.col("tied"), 0).otherwise(2), "high_kind": F.when(F.col("tied"), 2).otherwise(0)}
    )
    below = asked.select("feature", F.col("low").alias("v"), F.col("low_kind").alias("kind"))
    above = asked.select("feature", F.col("high").alias("v"), F.col("high_kind").alias("kind"))
    marked = below.unionByName(above).distinct().withColumn("n", F.lit(0).cast("long"))
    line = running(values.unionByName(marked), ["feature"], ["v", "kind"], {"upto": ("sum", "n")})
    marks = materialize(line.where("kind <> 1").select("feature", "v", "kind", "upto"), "mi-marks")
    low = marks.select("feature", F.col("v").alias("low"), F.col("kind").alias("low_kind"), F.col("upto").alias("before"))
    high = marks.select("feature", F.col("v").alias("high"), F.col("kind").alias("high_kind"), F.col("upto").alias("within"))
    counted = asked.join(low, ["feature", "low", "low_kind"]).join(high, ["feature", "high", "high_kind"])
    # Few distinct counts occur, so digamma is taken once per (feature, counts).
    grouped = counted.withColumn("m", F.greatest(F.col("within") - F.col("before"), F.lit(1))).groupBy("feature", "m", "nc", "k").agg(
        F.count(F.lit(1)).alias("times")
    )
    summed = grouped.groupBy("feature").agg(
        F.sum("times").alias("n"),
        (F.sum(F.col("times") * (digamma_of(F.col("k").cast("double")) - digamma_of(F.col("nc").cast("double")) - digamma_of(F.col("m").cast("double")))) / F.sum("times")).alias("mean"),
    )
    return summed.select("feature", F.greatest(digamma_of(F.col("n").cast("double")) + F.col("mean"), F.lit(0.0)).alias("mi"))


def rmsle(df: DataFrame, truth: str, predicted: str, floor: float = 1e-7) -> DataFrame:
    """Root mean squared error of log(1 + x); values are floored at a small positive number."""
    gap = F.log1p(F.greatest(F.col(predicted), F.lit(floor))) - F.log1p(F.greatest(F.col(truth), F.lit(floor)))
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmsle"))


def f1_micro(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Micro F1 times 100; with one label per row it is the share of right rows."""
    return df.groupBy(*(keys or [])).agg((F.avg((F.col(truth) == F.col(predicted)).cast("double")) * 100).alias("f1"))


def key_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only on the left, only on the right, and on both sides."""
    marked = left.select(key).distinct().withColumn("_l", F.lit(1)).join(
        right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full"
    )
    return marked.agg(
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("matched"),
    )
