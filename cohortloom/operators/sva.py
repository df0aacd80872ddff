"""Hidden covariates of counts by iteratively weighted surrogate variables.

Each round weighs genes by the chance that hidden factors, and not the group, move them, and takes the leading sample
directions of the weighted log counts: first a histogram of transformed p-values, then block power iteration. A step of it
multiplies the genes' rows with a few directions and sums the products over genes, so what moves and what the driver holds
is samples x directions; there is no product of samples by samples and no limit on samples.
"""

from __future__ import annotations

from dataclasses import replace
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortloom.functions.dist import f_sf
from cohortloom.operators.counts import GeneRows, count_matrix, pack_genes
from cohortloom.operators.sums import summed_array
from cohortloom.runtime import materialize

#: Directions that are iterated beyond those asked for, steps at most, and the change at which they are settled.
SPARE, STEPS, SETTLED = 8, 60, 1e-9
BINS, EDGE = 400, 8.0


def _f_p(data: np.ndarray, full: np.ndarray, null: np.ndarray) -> np.ndarray:
    """P-values of the F test of nested designs, row by row."""

    def rss(design: np.ndarray) -> np.ndarray:
        q, _ = np.linalg.qr(design)
        rest = data - (data @ q) @ q.T
        return np.sum(rest * rest, axis=1)

    d1, d2 = full.shape[1] - null.shape[1], data.shape[1] - full.shape[1]
    rss1, rss0 = rss(full), rss(null)
    stat = np.maximum(rss0 - rss1, 0) / d1 / np.maximum(rss1 / d2, 1e-300)
    return f_sf(stat, d1, d2)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution by bisection on a table; only the histogram bin of the result matters."""
    grid = np.linspace(-EDGE, EDGE, 4001)
    table = np.array([0.5 * erfc(-z / sqrt(2)) for z in grid])
    return np.interp(np.clip(p, 1e-15, 1 - 1e-15), table, grid)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.clip(((_normal_quantile(p) + EDGE) / (2 * EDGE) * BINS).astype(int), 0, BINS - 1)


def _local_fdr(histogram: np.ndarray, high: float) -> np.ndarray:
    """Local false discovery rate per bin: null density times its share over the smoothed density, falling with -z."""
    centers = (np.arange(BINS) + 0.5) / BINS * 2 * EDGE - EDGE
    total = max(histogram.sum(), 1.0)
    sd = np.sqrt(max((histogram * centers**2).sum() / total - ((histogram * centers).sum() / total) ** 2, 1e-4))
    width = max(1.5 * 0.9 * sd * total ** (-1 / 5), 2 * EDGE / BINS)
    kernel = np.exp(-0.5 * ((centers[:, None] - centers[None, :]) / width) ** 2) / (width * np.sqrt(2 * np.pi))
    density = kernel @ histogram / total
    null = np.exp(-0.5 * centers**2) / np.sqrt(2 * np.pi)
    share = min(high / (1 - 0.8) / total, 1.0)
    rate = np.minimum(share * null / np.maximum(density, 1e-300), 1.0)
    return np.maximum.accumulate(rate)  # p-values rise with z


def hidden_covariates(counts: DataFrame, design: DataFrame, group: str, n: int = 2, rounds: int = 5) -> DataFrame:
    """(sample, sv1 .. svn) for the samples of ``design`` (sample, group)."""
    known = materialize(design.select("sample", group).dropna(), "design")
    genes = pack_genes(counts, known)
    genes = replace(genes, rows=materialize(genes.rows, "gene-rows"))
    place = genes.place()
    groups = np.zeros(len(genes.samples))
    for row in known.collect():
        groups[place[row["sample"]]] = float(row[group])
    directions = hidden_directions(genes, np.arange(len(genes.samples)), groups, n, rounds)
    key = counts.schema["sample"].dataType.simpleString()
    names = ", ".join(f"sv{i + 1} double" for i in range(n))
    table = [(sample, *map(float, d)) for sample, d in zip(genes.samples, directions)]
    return counts.sparkSession.createDataFrame(table, f"sample {key}, {names}")


def hidden_directions(genes: GeneRows, at: np.ndarray, groups: np.ndarray, n: int = 2, rounds: int = 5) -> np.ndarray:
    """Samples by ``n`` directions for the samples at positions ``at``, given their groups.

    The entry of largest size is positive in every direction, which fixes the sign. ``genes.rows`` is cheap to read.
    """
    size, whole = len(at), len(genes.samples)
    sf, rows = genes.size_factors[at], genes.rows
    with_group = np.column_stack([np.ones(size), groups])
    without = np.ones((size, 1))

    def logs(batch: pd.DataFrame) -> np.ndarray:
        return np.log(count_matrix(batch, whole)[:, at] / sf + 1)

    def residuals(batch: pd.DataFrame) -> np.ndarray:
        data = logs(batch)
        q, _ = np.linalg.qr(with_group)
        return data - (data @ q) @ q.T

    directions = _leading(rows, residuals, size, n)
    if directions is None:
        return np.zeros((size, n))
    for _ in range(rounds):
        hidden = directions
        both, only = np.column_stack([with_group, hidden]), np.column_stack([without, hidden])

        def histograms(batch: pd.DataFrame, both=both, only=only) -> np.ndarray:
            data = logs(batch)
            out = []
            for full, null in ((both, only), (only, without)):
                p = _f_p(data, full, null)
                out += [np.bincount(_bin(p), minlength=BINS), [np.sum(p >= 0.8)]]
            return np.concatenate(out).astype(float)

        total = summed_array(rows, histograms, 2 * (BINS + 1))
        group_rate = _local_fdr(total[:BINS], total[BINS])
        hidden_rate = _local_fdr(total[BINS + 1 : -1], total[-1])

        def weighted(batch: pd.DataFrame, both=both, only=only, group_rate=group_rate, hidden_rate=hidden_rate) -> np.ndarray:
            data = logs(batch)
            moved_by_group = 1 - group_rate[_bin(_f_p(data, both, only))]
            moved_by_hidden = 1 - hidden_rate[_bin(_f_p(data, only, without))]
            data = data * (moved_by_hidden * (1 - moved_by_group))[:, None]
            return data - data.mean(axis=1, keepdims=True)

        found = _leading(rows, weighted, size, n, directions)
        if found is None:
            break
        directions = found
    return directions


def _leading(rows: DataFrame, values, size: int, n: int, near: np.ndarray | None = None) -> np.ndarray | None:
    """The ``n`` leading right singular vectors of the matrix whose rows ``values`` gives batch by batch; None if it is zero.

    Block power iteration from fixed random directions and ``near``, which are close if an earlier matrix was.
    """
    width = min(size, n + SPARE)
    block = np.random.default_rng(0).standard_normal((size, width))
    if near is not None:
        block[:, :n] = near
    block, _ = np.linalg.qr(block)
    last = None
    for _ in range(STEPS):

        def product(batch: pd.DataFrame, block=block) -> np.ndarray:
            data = values(batch)
            return (data.T @ (data @ block)).ravel()

        image = summed_array(rows, product, size * width).reshape(size, width)
        if not np.any(image):
            return None
        # The best directions within the block, then on to its image.
        strength, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        top = block @ turn[:, ::-1][:, :n]
        if last is not None and np.all(1 - np.abs((top * last).sum(axis=0)) < SETTLED):
            break
        last = top
        block, _ = np.linalg.qr(image @ turn[:, ::-1])
    signs = np.sign(top[np.abs(top).argmax(axis=0), np.arange(n)])
    return top * np.where(signs == 0, 1, signs)
