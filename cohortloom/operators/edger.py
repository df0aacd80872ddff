"""Differential counts with a method of its own: trimmed-mean factors, tagwise dispersions by weighted likelihood, likelihood-ratio test.

Shares the packing of genes and the regressions with ``nbtest``, and nothing that is estimated. Per run: one dispersion common to all genes
maximizes the summed adjusted likelihood; each gene's likelihood on a grid around it is averaged with that of the genes of near abundance
(a moving average along the order of mean counts, by prefix sums), and the gene's dispersion is where the weighted sum is highest.
Only grids summed over genes come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.dist import chi2_sf
from cohortloom.operators.counts import GeneRows, count_matrix
from cohortloom.operators.nbtest import LN2, Run, _fit, _loglik
from cohortloom.operators.ordered import counted_quantiles, plan_order, running, with_row
from cohortloom.runtime import materialize

# The usual trims of the factors, the grid of log2 dispersions around the common one, and the weight of the neighbours.
TRIM_RATIO, TRIM_ABUNDANCE = 0.3, 0.05
GRID = np.linspace(-6, 6, 11)
PRIOR_FREEDOM = 10.0
#: Genes with fewer counts do not shape the common dispersion; the range it is looked for in.
LEAST_COUNTS = 5
RANGE = (1e-4, 16.0)


def tmm_factors(counts: DataFrame) -> DataFrame:
    """(sample, lib_size, norm_factor): doubly trimmed weighted mean of log ratios to a reference sample, factors of product one.

    ``counts`` is (gene, sample, cnt), cells without a row are 0. The reference has the upper quartile, over library size, next to the mean of
    these. Genes that are 0 in either sample do not count. Ratios and abundances are compared to ten decimals.
    """
    cells = materialize(counts.where("cnt > 0").select("gene", "sample", F.col("cnt").cast("double").alias("cnt")), "tmm-cells")
    libs = cells.groupBy("sample").agg(F.sum("cnt").alias("lib_size"), F.count(F.lit(1)).alias("n"))
    libs = materialize(with_row(libs, cells.agg(F.countDistinct("gene").alias("genes"))), "tmm-libs")
    values = cells.groupBy("sample", "cnt").agg(F.count(F.lit(1)).alias("_n"))
    zeros = libs.where("genes > n").select("sample", F.lit(0.0).alias("cnt"), (F.col("genes") - F.col("n")).alias("_n"))
    upper = counted_quantiles(values.unionByName(zeros), ["sample"], "cnt", {"uq": 0.75}).join(libs, "sample")
    upper = upper.select("sample", "lib_size", (F.col("uq") / F.col("lib_size")).alias("uq"))
    far = F.round(F.abs(F.col("uq") - F.col("mean_uq")), 12).alias("far")
    reference = with_row(upper, upper.agg(F.avg("uq").alias("mean_uq"))).agg(
        F.min(F.struct(far, "sample", "lib_size")).alias("best")
    ).select(F.col("best.sample").alias("ref_sample"), F.col("best.lib_size").alias("ref_lib"))
    own = with_row(cells, reference)
    of_ref = own.where(F.col("sample") == F.col("ref_sample")).select("gene", F.col("cnt").alias("ref_cnt"))
    met = own.join(of_ref, "gene").join(libs.select("sample", "lib_size"), "sample")
    y, r = F.col("cnt") / F.col("lib_size"), F.col("ref_cnt") / F.col("ref_lib")
    ratios = materialize(
        met.select(
            "sample", F.round(F.log2(y / r), 10).alias("m"), F.round((F.log2(y) + F.log2(r)) / 2, 10).alias("a"),
            ((1 - y) / F.col("cnt") + (1 - r) / F.col("ref_cnt")).alias("w"),
        ),
        "tmm-ratios",
    )
    sizes = ratios.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("m")).alias("most"))
    ranked = _mean_rank(_mean_rank(ratios, "m"), "a").join(sizes, "sample")

    def inside(rank: str, share: float) -> Column:
        low = F.floor(F.col("n") * share) + 1
        return (F.col(rank) >= low) & (F.col(rank) <= F.col("n") + 1 - low)

    kept = ranked.where(inside("rank_m", TRIM_RATIO) & inside("rank_a", TRIM_ABUNDANCE) & (F.col("w") > 0) & (F.col("most") >= 1e-6))
    logs = kept.groupBy("sample").agg((F.sum(F.col("m") / F.col("w")) / F.sum(1 / F.col("w"))).alias("log_factor"))
    every = libs.select("sample", "lib_size").join(logs, "sample", "left").withColumn("log_factor", F.coalesce("log_factor", F.lit(0.0)))
    middle = every.agg(F.avg("log_factor").alias("middle"))
    return with_row(every, middle).select("sample", "lib_size", F.pow(F.lit(2.0), F.col("log_factor") - F.col("middle")).alias("norm_factor"))


def _mean_rank(rows: DataFrame, column: str) -> DataFrame:
    """``rank_<column>`` within the sample; equal values share the mean of their ranks."""
    counts = materialize(rows.groupBy("sample", column).agg(F.count(F.lit(1)).alias("_n")), "tmm-ranks")
    upto = running(counts, ["sample"], [column], {"_upto": ("sum", "_n")}, plan=plan_order(counts, [column]))
    rank = (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"rank_{column}")
    return rows.join(upto.select("sample", column, rank), ["sample", column])


def effective_sizes(counts: DataFrame) -> DataFrame:
    """(sample, size_factor): library size times trimmed-mean factor, of geometric mean one."""
    sizes = tmm_factors(counts).withColumn("size", F.log(F.col("lib_size") * F.col("norm_factor")))
    middle = sizes.agg(F.avg("size").alias("middle"))
    return with_row(sizes, middle).select("sample", F.exp(F.col("size") - F.col("middle")).alias("size_factor"))


def adjusted_likelihoods(y: np.ndarray, offset: np.ndarray, x: np.ndarray, dispersions: np.ndarray) -> np.ndarray:
    """Genes by dispersions: Cox-Reid adjusted profile likelihood of each gene's regression."""
    out = np.empty((len(y), len(dispersions)))
    for at, dispersion in enumerate(dispersions):
        alpha = np.full(len(y), dispersion)
        _, mu, _ = _fit(y, offset, x, alpha)
        w = mu / (1 + alpha[:, None] * mu)
        _, logdet = np.linalg.slogdet(np.einsum("gs,sp,sq->gpq", w, x, x) + 1e-12 * np.eye(x.shape[1]))
        out[:, at] = _loglik(y, mu, alpha) - 0.5 * logdet
    return out


def _summed(genes: GeneRows, runs: list[Run], grids: np.ndarray) -> np.ndarray:
    """Runs by dispersions: the adjusted likelihoods of each run's grid, summed over the genes with counts enough."""
    sf, n, width = genes.size_factors, len(genes.samples), grids.shape[1]

    def in_task(batches):
        total = np.zeros((len(runs), width))
        for batch in batches:
            whole = count_matrix(batch, n)
            for number, run in enumerate(runs):
                y = whole[:, run.at]
                y = y[y.sum(axis=1) >= LEAST_COUNTS]
                if len(y):
                    total[number] += adjusted_likelihoods(y, np.log(sf[run.at]), run.x, grids[number]).sum(axis=0)
        yield pd.DataFrame({"run": np.repeat(np.arange(len(runs)), width), "at": np.tile(np.arange(width), len(runs)), "value": total.ravel()})

    rows = genes.rows.mapInPandas(in_task, "run int, at int, value double").groupBy("run", "at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((len(runs), width))
    for row in rows:  # runs times the grid
        out[row["run"], row["at"]] = row["value"]
    return out


def peak(points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each row of values over the points, which are evenly spaced, is highest: the top of the parabola through the best point and its
    neighbours, or an end point."""
    best = values.argmax(axis=1)
    inner = np.clip(best, 1, len(points) - 2)
    row = np.arange(len(values))
    a, b, c = values[row, inner - 1], values[row, inner], values[row, inner + 1]
    bend = a - 2 * b + c
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.where(bend < 0, 0.5 * (a - c) / bend, 0.0)
    top = points[inner] + np.clip(shift, -1, 1) * (points[1] - points[0])
    return np.where(best == inner, top, points[best])


def common_dispersions(genes: GeneRows, runs: list[Run]) -> np.ndarray:
    """The dispersion of each run that all its genes share, from a coarse and a fine grid."""
    points = np.linspace(np.log(RANGE[0]), np.log(RANGE[1]), 13)
    first = peak(points, _summed(genes, runs, np.exp(np.tile(points, (len(runs), 1)))))
    step = points[1] - points[0]
    fine = np.linspace(-step, step, 9)
    values = _summed(genes, runs, np.exp(first[:, None] + fine))
    return np.exp(first + peak(fine, values))


def gene_grids(genes: GeneRows, runs: list[Run], common: np.ndarray) -> DataFrame:
    """(run, gene, base_mean, l0 .. l10): the gene's adjusted likelihood on the grid around the run's common dispersion."""
    sf, n = genes.size_factors, len(genes.samples)
    names = [f"l{i}" for i in range(len(GRID))]

    def in_task(batches):
        for batch in batches:
            whole = count_matrix(batch, n)
            for number, run in enumerate(runs):
                y, factors = whole[:, run.at], sf[run.at]
                counted = y.sum(axis=1) > 0
                if not counted.any():
                    continue
                values = adjusted_likelihoods(y[counted], np.log(factors), run.x, common[number] * 2**GRID)
                table = pd.DataFrame(values, columns=names)
                table.insert(0, "base_mean", (y[counted] / factors).mean(axis=1))
                table.insert(0, "gene", batch["gene"][counted].to_numpy())
                table.insert(0, "run", number)
                yield table

    key = genes.rows.schema["gene"].dataType.simpleString()
    schema = f"run int, gene {key}, base_mean double, " + ", ".join(f"{name} double" for name in names)
    return materialize(genes.rows.mapInPandas(in_task, schema), "edger-grids")


def near_genes(grids: DataFrame) -> DataFrame:
    """``grids`` with ``s0 .. s10``: means over the genes that are at most half a width away in the order of mean counts.

    The width is the share (10 / genes) ^ 0.23 of the run's genes. Sums come from prefix sums at both ends of the stretch.
    """
    places = range(len(GRID))
    measures = {f"p{i}": ("sum", f"l{i}") for i in places} | {"rn": ("sum", "_one")}
    upto = running(grids.withColumn("_one", F.lit(1).cast("long")), ["run"], ["base_mean", "gene"], measures)
    upto = materialize(upto.drop("_one"), "edger-sums")
    sizes = upto.groupBy("run").agg(F.max("rn").alias("genes"))
    share = F.when(F.col("genes") > 10, F.pow(10 / F.col("genes"), F.lit(0.23))).otherwise(1.0)
    half = F.floor(F.floor(share * F.col("genes")) / 2)
    ends = upto.join(sizes, "run").withColumns({"top": F.least(F.col("rn") + half, "genes"), "low": F.greatest(F.col("rn") - half - 1, F.lit(0))})

    def at(place: str) -> DataFrame:
        return upto.select(F.col("run").alias(f"{place}_run"), F.col("rn").alias(f"{place}_rn"), *[F.col(f"p{i}").alias(f"{place}{i}") for i in places])

    met = ends.join(at("top_"), (F.col("run") == F.col("top__run")) & (F.col("top") == F.col("top__rn")))
    met = met.join(at("low_"), (F.col("run") == F.col("low__run")) & (F.col("low") == F.col("low__rn")), "left")
    means = {f"s{i}": (F.col(f"top_{i}") - F.coalesce(f"low_{i}", F.lit(0.0))) / (F.col("top") - F.col("low")) for i in places}
    return met.withColumns(means).select(*grids.columns, *means)


def tagwise_dispersions(genes: GeneRows, runs: list[Run]) -> DataFrame:
    """(gene, runs, dispersions): for the places of the runs in which the gene has counts, its own dispersion."""
    common = common_dispersions(genes, runs)
    weight = np.array([PRIOR_FREEDOM / max(len(run.at) - run.x.shape[1], 1) for run in runs])
    places = range(len(GRID))

    def in_task(batches):
        for batch in batches:
            if len(batch):
                run = batch["run"].to_numpy()
                own, near = (batch[[f"{kind}{i}" for i in places]].to_numpy() for kind in "ls")
                top = peak(GRID, (own + weight[run, None] * near) / (1 + weight[run, None]))
                yield pd.DataFrame({"gene": batch["gene"], "run": run, "dispersion": common[run] * 2**top})

    grids = gene_grids(genes, runs, common)
    key = genes.rows.schema["gene"].dataType.simpleString()
    found = near_genes(grids).mapInPandas(in_task, f"gene {key}, run int, dispersion double")
    listed = found.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("run", "dispersion"))).alias("of"))  # as long as there are runs
    return listed.select("gene", F.col("of.run").alias("runs"), F.col("of.dispersion").alias("dispersions"))


def ratio_tests(genes: GeneRows, runs: list[Run], tested: int, run_type: str) -> DataFrame:
    """(run_id, gene, base_mean, log2fc, lfc_se, stat, pvalue) of the tested design column."""
    table = genes.rows.join(tagwise_dispersions(genes, runs), "gene")
    sf, n = genes.size_factors, len(genes.samples)

    def in_task(batches):
        for batch in batches:
            if not len(batch):
                continue
            whole = count_matrix(batch, n)
            alphas = np.full((len(batch), len(runs)), np.nan)
            for at, (places, values) in enumerate(zip(batch["runs"], batch["dispersions"])):
                alphas[at, places] = values
            for number, run in enumerate(runs):
                counted = ~np.isnan(alphas[:, number])
                if not counted.any():
                    continue
                y, factors, alpha = whole[counted][:, run.at], sf[run.at], alphas[counted, number]
                beta, mu, covariance = _fit(y, np.log(factors), run.x, alpha)
                _, mu0, _ = _fit(y, np.log(factors), np.delete(run.x, tested, axis=1), alpha)
                stat = np.maximum(2 * (_loglik(y, mu, alpha) - _loglik(y, mu0, alpha)), 0)
                yield pd.DataFrame({
                    "run_id": run.name, "gene": batch["gene"][counted], "base_mean": (y / factors).mean(axis=1), "log2fc": beta[:, tested] / LN2,
                    "lfc_se": np.sqrt(covariance[:, tested, tested]) / LN2, "stat": stat, "pvalue": chi2_sf(stat, 1.0),
                })

    key = genes.rows.schema["gene"].dataType.simpleString()
    schema = f"run_id {run_type}, gene {key}, base_mean double, log2fc double, lfc_se double, stat double, pvalue double"
    return table.mapInPandas(in_task, schema)
