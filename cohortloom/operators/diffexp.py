"""Work on differential results: effect cuts, adjusted p-values, classes, consensus over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ordered import plan_order, running, with_row
from cohortloom.runtime import materialize


def two_sided_effect(deg: DataFrame, log2fc: float, limit: float, effect: str = "log2fc", p: str = "padj") -> DataFrame:
    """Rows with an effect of at least ``log2fc`` either way and ``p`` below ``limit``; nulls fail."""
    return deg.where((F.abs(F.col(effect)) >= log2fc) & (F.col(p) < limit))


def labelled(groups: DataFrame, group: str, reverse: bool = False) -> DataFrame:
    """Sub0 and Sub1 from group 0 and 1, swapped first if ``reverse``; an unknown group has no label."""
    value = 1 - F.col(group) if reverse else F.col(group)
    return groups.withColumn(group, value).withColumn(
        "label", F.when(F.col(group) == 0, "Sub0").when(F.col(group) == 1, "Sub1")
    )


def fdr_bh(df: DataFrame, p: str, keys: list[str], out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within ``keys``; null p-values stay null and do not count.

    Equal p-values share the adjusted value of the last of them, so one row per distinct value is enough for the
    running count and the running minimum.
    """
    counts = materialize(
        df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")), "tests"
    )
    upto = running(counts, keys, ["_p"], {"_rank": ("sum", "_n")}, plan=plan_order(counts, ["_p"]))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    raw = upto.join(sizes, keys) if keys else with_row(upto, sizes)
    raw = raw.withColumn("_q", F.least(F.lit(1.0), F.col("_p") * F.col("_m") / F.col("_rank")))
    adjusted = running(raw.select(*keys, "_p", "_q"), keys, ["_p"], {out: ("min", "_q")}, reverse=True)
    lookup = adjusted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_p", out)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(p) == F.col("_p")]
    joined = df.join(lookup, same, "left")
    return joined.drop("_p", *[f"_k_{k}" for k in keys])


def volcano_class(deg: DataFrame, p_limit: float = 0.05, fc_limit: float = 1.5, p: str = "padj") -> DataFrame:
    """NS, FC, P or both, by strict comparison; a null p-value counts as not significant."""
    far = F.coalesce(F.abs(F.col("log2fc")) > fc_limit, F.lit(False))
    sure = F.coalesce(F.col(p) < p_limit, F.lit(False))
    return deg.withColumn(
        "volcano", F.when(far & sure, "FC and P").when(far, "FC").when(sure, "P").otherwise("NS")
    )


def consensus(deg: DataFrame, n_runs: int) -> DataFrame:
    """Per gene over the cut results of all runs: share of runs with a result, median and mean effect."""
    return deg.groupBy("gene").agg(
        (F.count("log2fc") * 100.0 / n_runs).alias("present_percent"),
        F.median("log2fc").alias("log2fc_median"),
        F.avg("log2fc").alias("log2fc_mean"),
    )


def wide_by_run(deg: DataFrame, runs: list, metrics: dict[str, str]) -> DataFrame:
    """One row per gene with ``SubGroup-<run>_<metric>`` columns in run order."""
    wide = deg.groupBy("gene").pivot("run_id", runs).agg(*[F.first(c, ignorenulls=True).alias(m) for m, c in metrics.items()])
    names = [f"`{run}_{m}`" if len(metrics) > 1 else f"`{run}`" for run in runs for m in metrics]
    labels = [f"SubGroup-{run}_{m}" for run in runs for m in metrics]
    return wide.select("gene", *[F.col(n).alias(label) for n, label in zip(names, labels)])
