"""Expression counts: between-sample normalization, size factors, and packing of genes for per-gene models."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ordered import quantiles, with_row
from cohortloom.runtime import has_at_most, materialize

MAX_SAMPLES = 1_000_000  # one packed gene row then takes 8 MB
CELLS_PER_TASK = 4_000_000


STRATA = 10


def strata(gene_info: DataFrame, number: int = STRATA) -> DataFrame:
    """(gene, stratum) from (gene, measure): equal shares of the genes by their measure, such as length or composition; equal measures
    stay together, in the lower stratum."""
    edges = quantiles(gene_info, [], "measure", {f"_e{i}": i / number for i in range(1, number)})
    met = with_row(gene_info.where("measure IS NOT NULL"), edges.select(F.array(*[f"_e{i}" for i in range(1, number)]).alias("_edges")))
    return met.select("gene", F.size(F.filter("_edges", lambda edge: edge < F.col("measure"))).alias("stratum"))


def within_samples(cells: DataFrame, gene_info: DataFrame, number: int = STRATA) -> DataFrame:
    """(gene, sample, cnt) with counts over what the upper quartile of their stratum is to that of their sample, so that genes of a kind
    are as high as those of any other kind. Quartiles are over counts above 0; genes without a measure are left out."""
    placed = materialize(cells.join(strata(gene_info, number), "gene"), "strata-cells")
    positive = placed.where("cnt > 0")
    whole = quantiles(positive, ["sample"], "cnt", {"whole": 0.75})
    parts = quantiles(positive, ["sample", "stratum"], "cnt", {"part": 0.75}).join(whole, "sample")
    scaled = placed.join(parts, ["sample", "stratum"], "left")
    return scaled.select("gene", "sample", F.coalesce(F.col("cnt") / F.col("part") * F.col("whole"), F.lit(0.0)).alias("cnt"))


def norm_counts(counts: DataFrame, gene_info: DataFrame | None = None) -> DataFrame:
    """Upper-quartile normalization: counts over the sample's upper quartile of nonzero counts, on a common scale.

    The scale is the geometric mean of the quartiles over samples. With ``gene_info`` (gene, measure) the strata of a sample are
    brought to one level first.
    """
    value = F.col("cnt").cast("double")
    cells = counts.select("gene", "sample", value.alias("cnt"))
    if gene_info is not None:
        cells = materialize(within_samples(cells, gene_info), "within-samples")
    quartiles = quantiles(cells.where("cnt > 0"), ["sample"], "cnt", {"uq": 0.75})
    common = quartiles.agg(F.exp(F.avg(F.log("uq"))).alias("common"))
    scaled = cells.join(with_row(quartiles, common), "sample")
    return scaled.select("gene", "sample", (F.col("cnt") / F.col("uq") * F.col("common")).alias("value"))


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios to the geometric mean, over genes that are positive in every sample; (sample, size_factor)."""
    positive = counts.where("cnt > 0").select("gene", "sample", F.log(F.col("cnt").cast("double")).alias("log_cnt"))
    samples = counts.agg(F.countDistinct("sample").alias("n"))
    per_gene = positive.groupBy("gene").agg(F.avg("log_cnt").alias("center"), F.count(F.lit(1)).alias("present"))
    everywhere = with_row(per_gene, samples).where(F.col("present") == F.col("n")).select("gene", "center")
    ratios = positive.join(everywhere, "gene").select("sample", (F.col("log_cnt") - F.col("center")).alias("ratio"))
    return quantiles(ratios, ["sample"], "ratio", {"mid": 0.5}).select("sample", F.exp("mid").alias("size_factor"))


@dataclass(frozen=True)
class GeneRows:
    """Genes as rows of counts in one sample order, with the size factors in that order."""

    rows: DataFrame  # gene, positions, cell_counts
    samples: list
    size_factors: np.ndarray

    def place(self) -> dict:
        return {sample: at for at, sample in enumerate(self.samples)}


def pack_genes(counts: DataFrame, samples: DataFrame, factors: DataFrame | None = None) -> GeneRows:
    """One row per gene over the given samples; cells without a count are 0, genes without any are left out.

    ``samples`` is cheap to read. Per-gene models need the whole row of a gene. Its length is the number of samples, which is checked; genes are spread
    over tasks by a bound on cells.
    """
    wanted = samples.select("sample").distinct()
    if not has_at_most(wanted, MAX_SAMPLES):
        raise ValueError(f"more than {MAX_SAMPLES} samples: a gene row would not fit a task")
    counts = materialize(counts.select("gene", "sample", "cnt").join(wanted, "sample", "left_semi"), "counts")
    table = wanted.join(factors if factors is not None else size_factors(counts), "sample", "left").orderBy("sample").collect()
    if any(row["size_factor"] is None for row in table):
        raise ValueError("no gene is positive in every sample: size factors are not defined")
    names = [row["sample"] for row in table]
    spark = counts.sparkSession
    key = counts.schema["sample"].dataType.simpleString()
    place = spark.createDataFrame(list(zip(names, range(len(names)))), f"sample {key}, position int")
    packed = counts.where("cnt > 0").join(place, "sample").groupBy("gene").agg(
        F.collect_list(F.struct("position", F.col("cnt").cast("double").alias("cnt"))).alias("cells")
    )
    packed = materialize(
        packed.select("gene", F.col("cells.position").alias("positions"), F.col("cells.cnt").alias("cell_counts")), "gene-cells"
    )
    genes = packed.count()
    tasks = max(1, ceil(genes * len(names) / CELLS_PER_TASK), min(spark.sparkContext.defaultParallelism, ceil(genes / 20)))
    return GeneRows(packed.repartition(tasks, "gene"), names, np.array([row["size_factor"] for row in table], dtype=float))


def count_matrix(batch, samples: int) -> np.ndarray:
    """Genes by samples from a batch of packed rows."""
    out = np.zeros((len(batch), samples))
    for at, (positions, cells) in enumerate(zip(batch["positions"], batch["cell_counts"])):
        out[at, positions] = cells
    return out
