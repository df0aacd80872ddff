"""Independent filtering: the cut on mean counts at which adjusted p-values reject most, and the p-values adjusted behind it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.diffexp import fdr_bh
from cohortloom.operators.ordered import running, with_row
from cohortloom.runtime import materialize

# The usual number of cuts and the highest quantile; the share of cuts that a smoothed value looks at; rejections too few to choose by.
CUTS, TOP, SPAN, FEW = 50, 0.95, 0.2, 10


def cutoffs(df: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """(keys, cutoffs): quantiles of ``base`` from the key's share of zeros to 95 % (to all, if there are more zeros), evenly spaced.

    A value answers for the places between the counts below it and up to it, so one pass over the ranked values gives all quantiles.
    """
    value = F.col(base)
    counts = df.where(value.isNotNull()).groupBy(*keys, base).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, [base], {"_upto": ("sum", "_n")})
    sizes = ranked.groupBy(*keys).agg(F.max("_upto").alias("_size"), F.coalesce(F.max(F.when(value == 0, F.col("_n"))), F.lit(0)).alias("_zeros"))
    sized = ranked.join(sizes, keys) if keys else with_row(ranked, sizes)
    low = F.col("_zeros") / F.col("_size")
    top = F.when(low < TOP, F.lit(TOP)).otherwise(1.0)

    def place(i: Column) -> Column:
        return (low + (top - low) * (i / F.lit(CUTS - 1.0))) * (F.col("_size") - 1)

    def covered(i: Column, end) -> Column:
        at = end(place(i))
        return (at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto"))

    places = F.sequence(F.lit(0), F.lit(CUTS - 1))
    here = F.filter(places, lambda i: covered(i, F.floor) | covered(i, F.ceil))
    at = F.col("_at")
    found = sized.withColumn("_at", F.explode(here)).groupBy(*keys, "_at").agg(
        F.max(F.when(covered(at, F.floor), value)).alias("_low"), F.max(F.when(covered(at, F.ceil), value)).alias("_high"),
        F.max(place(at) - F.floor(place(at))).alias("_share"),
    )
    cut = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")
    listed = F.sort_array(F.collect_list(F.struct("_at", cut.alias("_cut"))))  # fifty
    out = found.groupBy(*keys).agg(listed.alias("_cuts")) if keys else found.agg(listed.alias("_cuts"))
    return out.select(*keys, F.col("_cuts._cut").alias("cutoffs"))


def behind_cuts(df: DataFrame, p: str, base: str, keys: list[str], found: DataFrame | None = None) -> DataFrame:
    """Every row once for each cut that keeps it, with ``cut`` (place in the grid) and ``padj`` adjusted among the rows of that cut; the
    rows of all cuts are ranked in the same pass."""
    found = cutoffs(df, base, keys) if found is None else found
    met = df.join(found, keys) if keys else with_row(df, found)
    kept = F.filter(F.sequence(F.lit(0), F.lit(CUTS - 1)), lambda i: F.get("cutoffs", i) <= F.col(base))
    return fdr_bh(met.withColumn("cut", F.explode(kept)).drop("cutoffs"), p, [*keys, "cut"])


def smoothed(x: np.ndarray, y: np.ndarray, span: float = SPAN, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines through the nearest points (tricube weights), made robust by bisquare weights of the residuals."""
    n = len(x)
    near = max(2, min(n, int(span * n + 1e-7)))
    sure = np.ones(n)
    for _ in range(rounds + 1):
        out = np.empty(n)
        for i in range(n):
            far = np.abs(x - x[i])
            reach = np.sort(far)[near - 1]
            w = np.where(far < 0.999 * reach, (1 - np.minimum(far / max(reach, 1e-300), 1) ** 3) ** 3, 0.0)
            w = np.where(far <= 0.001 * reach, 1.0, w) * sure
            if w.sum() <= 0:
                out[i] = y[i]
                continue
            w = w / w.sum()
            middle = w @ x
            spread = w @ (x - middle) ** 2
            slope = (w @ ((x - middle) * y)) / spread if np.sqrt(spread) > 0.001 * (x[-1] - x[0]) else 0.0
            out[i] = w @ y + slope * (x[i] - middle)
        gap = np.abs(y - out)
        six = 6 * np.median(gap)
        if six < 1e-7 * np.mean(gap) or six == 0:
            break
        sure = np.where(gap <= 0.001 * six, 1.0, np.where(gap <= 0.999 * six, (1 - np.minimum(gap / six, 1) ** 2) ** 2, 0.0))
    return out


def chosen_cut(thetas: np.ndarray, rejected: np.ndarray) -> int:
    """The first cut whose rejections come within the scatter of the smoothed curve's top; the first of all if there are few."""
    if rejected.max(initial=0) <= FEW:
        return 0
    curve = smoothed(thetas, rejected.astype(float))
    some = rejected > 0
    scatter = np.sqrt(np.mean((rejected[some] - curve[some]) ** 2)) if some.any() else 0.0
    for least in (curve.max() - scatter, 0.9 * curve.max(), 0.8 * curve.max()):
        over = np.flatnonzero(rejected > least)
        if len(over):
            return int(over[0])
    return 0


def rejections(df: DataFrame, p: str, base: str, keys: list[str], alpha: float, found: DataFrame | None = None) -> DataFrame:
    """(keys, cut, n): adjusted p-values below ``alpha`` behind each cut that has any."""
    below = behind_cuts(df, p, base, keys, found).where(F.col("padj") < alpha)
    return below.groupBy(*keys, "cut").agg(F.count(F.lit(1)).alias("n"))


def filtered_fdr(df: DataFrame, p: str, base: str, keys: list[str], alpha: float) -> DataFrame:
    """``df``, which is cheap to read, with ``padj`` behind the cut chosen for each key; rows below it have none."""
    spark = df.sparkSession
    found = materialize(cutoffs(df, base, keys), "cutoffs")
    counts: dict[tuple, np.ndarray] = {}
    for row in rejections(df, p, base, keys, alpha, found).collect():  # 50 rows a key
        counts.setdefault(tuple(row[k] for k in keys), np.zeros(CUTS))[row["cut"]] = row["n"]
    thetas = np.linspace(0, TOP, CUTS)  # only their even spacing matters to the curve
    chosen = [(*key, chosen_cut(thetas, n)) for key, n in counts.items()]
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "cut int"])
    if keys:
        found = found.join(spark.createDataFrame(chosen, schema), keys, "left")
    else:
        found = found.withColumn("cut", F.lit(chosen[0][0] if chosen else 0))
    least = found.select(*keys, F.get("cutoffs", F.coalesce("cut", F.lit(0))).alias("_least"))
    met = df.join(least, keys) if keys else with_row(df, least)
    kept = met.withColumn("_kept_p", F.when(F.col(base) >= F.col("_least"), F.col(p)))
    return fdr_bh(kept, "_kept_p", keys).drop("_kept_p", "_least")
