"""Differential expression of counts: negative binomial models per gene, shrunken dispersions, Wald and likelihood-ratio tests.

Genes are rows of counts spread over tasks; every task fits its genes together in numpy, for all runs (groupings of the
samples) at once. The dispersion trend and the prior width of each run come from aggregates over the gene table, so no
gene table is collected.

The Wald test has the usual guards. Cook's distance tells how much a count moves its gene's fit. Where a group has enough samples, a count
that moves it too much is replaced by the trimmed mean and that gene alone is fitted again; where it has fewer, the gene gets no
p-value. P-values are adjusted behind the cut on mean counts that rejects most (``filtering``). The likelihood-ratio test of
``run_tests`` is a method of its own (``edger``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.dist import chi2_sf, f_sf, log_gamma, normal_sf2, trigamma
from cohortloom.operators.counts import GeneRows, count_matrix, pack_genes
from cohortloom.operators.diffexp import fdr_bh
from cohortloom.operators.filtering import filtered_fdr
from cohortloom.operators.ordered import quantiles
from cohortloom.operators.sva import hidden_directions
from cohortloom.runtime import has_at_most, materialize, side_by_side, union_all

LEAST_DISPERSION = 1e-8
RIDGE = 1e-6  # on the log2 scale, as a guard against separated groups
LN2 = np.log(2)
MAX_DESIGN_ROWS = 5_000_000
MAD = 1.4826  # median absolute deviation to standard deviation
RESULT = ["gene", "base_mean", "log2fc", "lfc_se", "stat", "pvalue", "padj"]
# How sure a count must be out of line; samples of a group that allow to judge, and to replace, its counts; the trimmed shares and
# scales of the robust variance by the size of a group; and the significance that filtering aims at.
OUTLIER_QUANTILE, LEAST_JUDGED, LEAST_REPLACED, TRIMMED_MEAN = 0.99, 3, 7, 0.2
TRIMS = ((3.5, 1 / 3, 2.04), (23.5, 1 / 4, 1.86), (float("inf"), 1 / 8, 1.51))
LEAST_ROBUST, LARGER_COUNTS = 0.04, 3
FILTER_ALPHA = 0.9999


@dataclass(frozen=True)
class Run:
    """One grouping: the positions of its samples and their design matrix, intercept first."""

    name: object
    at: np.ndarray
    x: np.ndarray


def designs_of(genes: GeneRows, designs: DataFrame, columns: list[str]) -> list[Run]:
    """Design matrices from (run_id, sample, *columns); rows with a null are left out of their run."""
    place = genes.place()
    if not has_at_most(designs, MAX_DESIGN_ROWS):
        raise ValueError(f"more than {MAX_DESIGN_ROWS} design rows: test fewer runs at a time")
    rows: dict = {}
    for row in designs.select("run_id", "sample", *columns).dropna().collect():
        rows.setdefault(row["run_id"], []).append((place[row["sample"]], [float(row[c]) for c in columns]))
    runs = []
    for name in sorted(rows):
        found = sorted(rows[name])
        x = np.column_stack([np.ones(len(found)), np.array([values for _, values in found])])
        runs.append(Run(name, np.array([at for at, _ in found]), x))
    return runs


def _fit(y: np.ndarray, offset: np.ndarray, x: np.ndarray, alpha: np.ndarray, rounds: int = 60):
    """Coefficients (natural log), fitted means and covariances of NB regressions with known dispersion, gene by gene."""
    genes, p = len(y), x.shape[1]
    start = np.log((y / np.exp(offset)).mean(axis=1) + 1e-8)
    beta = np.zeros((genes, p))
    beta[:, 0] = start
    ridge = np.eye(p) * RIDGE / LN2**2
    last = np.full(genes, np.inf)
    active = np.ones(genes, dtype=bool)
    for _ in range(rounds):
        at = np.flatnonzero(active)
        if not len(at):
            break
        eta = np.clip(beta[at] @ x.T, -30, 30)
        mu = np.exp(eta + offset)
        w = mu / (1 + alpha[at, None] * mu)
        z = eta + (y[at] - mu) / mu
        xtwx = np.einsum("gs,sp,sq->gpq", w, x, x) + ridge
        beta[at] = np.clip(np.linalg.solve(xtwx, np.einsum("gs,sp->gp", w * z, x)[..., None])[..., 0], -30, 30)
        mu = np.exp(np.clip(beta[at] @ x.T, -30, 30) + offset)
        deviance = -2 * _loglik(y[at], mu, alpha[at])
        active[at] = np.abs(deviance - last[at]) > 1e-8 * (np.abs(deviance) + 0.1)
        last[at] = deviance
    mu = np.exp(np.clip(beta @ x.T, -30, 30) + offset)
    w = mu / (1 + alpha[:, None] * mu)
    plain = np.einsum("gs,sp,sq->gpq", w, x, x)
    inverse = np.linalg.inv(plain + ridge)
    covariance = inverse @ plain @ inverse
    return beta, mu, covariance


def _loglik(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Negative binomial log likelihood without the terms that depend on the counts alone."""
    size = (1 / alpha)[:, None]
    a = alpha[:, None]
    return np.sum(log_gamma(y + size) - log_gamma(size) - (y + size) * np.log1p(a * mu) + y * np.log(a * mu + 1e-300), axis=1)


def _best_dispersion(y, mu, x, top: float, center=None, width: float | None = None) -> np.ndarray:
    """Dispersion with the largest Cox-Reid adjusted likelihood; with ``center`` and ``width`` under a log-normal prior."""

    def score(log_alpha: np.ndarray) -> np.ndarray:
        alpha = np.exp(log_alpha)
        w = mu / (1 + alpha[:, None] * mu)
        _, logdet = np.linalg.slogdet(np.einsum("gs,sp,sq->gpq", w, x, x) + 1e-12 * np.eye(x.shape[1]))
        value = _loglik(y, mu, alpha) - 0.5 * logdet
        return value if center is None else value - (log_alpha - center) ** 2 / (2 * width)

    low, high = np.log(LEAST_DISPERSION), np.log(top)
    grid = np.linspace(low, high, 24)
    values = np.stack([score(np.full(len(y), g)) for g in grid], axis=1)
    best = np.clip(values.argmax(axis=1), 1, len(grid) - 2)
    a, b = grid[best - 1].copy(), grid[best + 1].copy()
    golden = (np.sqrt(5) - 1) / 2
    c, d = b - golden * (b - a), a + golden * (b - a)
    fc, fd = score(c), score(d)
    for _ in range(30):
        left = fc > fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        new = np.where(left, b - golden * (b - a), a + golden * (b - a))
        fnew = score(new)
        c, d, fc, fd = np.where(left, new, d), np.where(left, c, new), np.where(left, fnew, fd), np.where(left, fc, fnew)
    return np.exp((a + b) / 2)


def trimmed_mean(values: np.ndarray, share: float) -> np.ndarray:
    """Mean along the last axis without the ``share`` of its lowest and of its highest values."""
    cut = int(values.shape[-1] * share)
    return np.sort(values, axis=-1)[..., cut : values.shape[-1] - cut].mean(axis=-1)


def _robust_variance(scaled: np.ndarray) -> np.ndarray:
    """Scaled trimmed mean of squares around the trimmed mean, of each gene over the given samples."""
    _, share, scale = next(t for t in TRIMS if scaled.shape[1] <= t[0])
    gaps = (scaled - trimmed_mean(scaled, share)[:, None]) ** 2
    return scale * trimmed_mean(gaps, share)


@dataclass(frozen=True)
class Cells:
    """Samples of a run with the same design row: the place of each, and how many there are in its cell."""

    of: np.ndarray
    size: np.ndarray

    @staticmethod
    def in_design(x: np.ndarray) -> Cells:
        _, of, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        return Cells(of.ravel(), n[of.ravel()])


def cooks_distances(y: np.ndarray, factors: np.ndarray, x: np.ndarray, mu: np.ndarray, alpha: np.ndarray, cells: Cells) -> np.ndarray:
    """Genes by samples: how far a count moves its gene's coefficients, from its leverage and its distance from the fit in units of a
    variance that outliers do not widen."""
    scaled = y / factors
    judged = [c for c in np.unique(cells.of) if (cells.of == c).sum() >= LEAST_JUDGED]
    spread = [_robust_variance(scaled[:, cells.of == c]) for c in judged] if judged else [_robust_variance(scaled)]
    mean = scaled.mean(axis=1)
    robust = np.maximum((np.max(spread, axis=0) - mean) / mean**2, LEAST_ROBUST)
    w = mu / (1 + alpha[:, None] * mu)
    p = x.shape[1]
    inverse = np.linalg.inv(np.einsum("gs,sp,sq->gpq", w, x, x) + np.eye(p) * RIDGE / LN2**2)
    leverage = np.clip(w * np.einsum("sp,gpq,sq->gs", x, inverse, x), 0, 1 - 1e-9)
    variance = mu + robust[:, None] * mu**2
    return (y - mu) ** 2 / variance / p * leverage / (1 - leverage) ** 2


def outlier_cut(samples: int, coefficients: int) -> float:
    """The F quantile a distance must exceed, by halving."""
    low, high = 0.0, 1.0
    tail = lambda f: float(f_sf(np.array([f]), float(coefficients), float(samples - coefficients))[0])
    while tail(high) > 1 - OUTLIER_QUANTILE:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > 1 - OUTLIER_QUANTILE else (low, middle)
    return high


def _own_dispersions(y: np.ndarray, factors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of normalized counts and dispersion of genes that have counts, each by itself."""
    top = max(10.0, float(len(factors)))
    scaled = y / factors
    mean, var = scaled.mean(axis=1), scaled.var(axis=1, ddof=1)
    alpha = np.clip((var - mean * np.mean(1 / factors)) / mean**2, LEAST_DISPERSION, top)
    for _ in range(2):
        _, mu, _ = _fit(y, np.log(factors), x, alpha)
        alpha = _best_dispersion(y, mu, x, top)
    return mean, alpha


def gene_dispersions(genes: GeneRows, runs: list[Run]) -> DataFrame:
    """Genes with, per run, the mean of normalized counts and the gene's own dispersion (null if the run has no count)."""
    sf, n = genes.size_factors, len(genes.samples)

    def in_task(batches):
        for batch in batches:
            whole = count_matrix(batch, n)
            means, own = np.full((len(whole), len(runs)), np.nan), np.full((len(whole), len(runs)), np.nan)
            for number, run in enumerate(runs):
                y, factors, x = whole[:, run.at], sf[run.at], run.x
                counted = y.sum(axis=1) > 0
                y = y[counted]
                if not len(y):
                    continue
                means[counted, number], own[counted, number] = _own_dispersions(y, factors, x)
            yield batch.assign(base_mean=list(means), disp_gene=list(own))

    key = genes.rows.schema["gene"].dataType.simpleString()
    schema = f"gene {key}, positions array<int>, cell_counts array<double>, base_mean array<double>, disp_gene array<double>"
    return materialize(genes.rows.mapInPandas(in_task, schema), "gene-dispersions")


def dispersion_points(table: DataFrame) -> DataFrame:
    """(run, base_mean, disp_gene) of the genes that may shape the trend; ``run`` is the run's place in the list."""
    points = table.select(F.posexplode(F.arrays_zip("base_mean", "disp_gene")).alias("run", "p")).select("run", "p.*")
    return points.where(~F.isnan("disp_gene") & (F.col("disp_gene") > 100 * LEAST_DISPERSION))


def _per_run(values: np.ndarray) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("run"))


def dispersion_trend(points: DataFrame, runs: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(a0, a1) per run of dispersion = a0 + a1 / mean: gamma regressions with identity link from aggregated sums.

    Genes far from the curve leave the fit. Where the regression fails, the curve is flat at the mean of the dispersions.
    """
    flat = np.full(runs, LEAST_DISPERSION)
    for row in points.groupBy("run").agg(F.avg("disp_gene").alias("flat")).collect():  # one row per run
        flat[row["run"]] = row["flat"]
    a0, a1 = np.full(runs, 0.1), np.full(runs, 1.0)
    failed, settled = np.zeros(runs, dtype=bool), np.zeros(runs, dtype=bool)
    u, d = 1 / F.col("base_mean"), F.col("disp_gene")
    for _ in range(rounds):
        fitted = _per_run(a0) + _per_run(a1) * u
        near = points.where((d / fitted > 1e-4) & (d / fitted < 15))
        w = 1 / (fitted * fitted)
        sums = {"w": w, "wu": w * u, "wuu": w * u * u, "wd": w * d, "wud": w * u * d}
        found = {r["run"]: r for r in near.groupBy("run").agg(*[F.sum(e).alias(k) for k, e in sums.items()]).collect()}
        for run in np.flatnonzero(~failed & ~settled):
            s = found.get(int(run))
            det = s["w"] * s["wuu"] - s["wu"] ** 2 if s else 0.0
            b0 = (s["wuu"] * s["wd"] - s["wu"] * s["wud"]) / det if det else 0.0
            b1 = (s["w"] * s["wud"] - s["wu"] * s["wd"]) / det if det else 0.0
            if b0 <= 0 or b1 <= 0:
                failed[run] = True
                continue
            settled[run] = np.log(b0 / a0[run]) ** 2 + np.log(b1 / a1[run]) ** 2 < 1e-6
            a0[run], a1[run] = b0, b1
        if np.all(failed | settled):
            break
    return np.where(failed, flat, a0), np.where(failed, 0.0, a1)


def prior_widths(points: DataFrame, a0: np.ndarray, a1: np.ndarray, freedom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run: variance of the log dispersions around the trend, and its part beyond sampling noise (at least 0.25)."""
    fitted = _per_run(a0) + _per_run(a1) / F.col("base_mean")
    residual = points.select("run", (F.log("disp_gene") - F.log(fitted)).alias("r"))
    middle = quantiles(residual, ["run"], "r", {"mid": 0.5})
    gaps = residual.join(middle, "run").select("run", F.abs(F.col("r") - F.col("mid")).alias("gap"))
    observed = np.zeros(len(a0))
    for row in quantiles(gaps, ["run"], "gap", {"mad": 0.5}).collect():  # one row per run
        observed[row["run"]] = (MAD * row["mad"]) ** 2
    noise = trigamma(np.maximum(freedom, 1) / 2.0)
    return observed, np.maximum(observed - noise, 0.25)


def _tests(genes: GeneRows, table: DataFrame, runs: list[Run], tested: int, method: str, run_type: str) -> DataFrame:
    """Shrunken dispersions and the test of one design column for every gene and run."""
    sf, n = genes.size_factors, len(genes.samples)
    points = dispersion_points(table)
    a0, a1 = dispersion_trend(points, len(runs))
    observed, width = prior_widths(points, a0, a1, np.array([len(r.at) - r.x.shape[1] for r in runs]))

    def fitted_genes(number: int, y: np.ndarray, mean: np.ndarray, own: np.ndarray):
        """Shrunken dispersions, coefficients, means and covariances of genes of a run."""
        run, offset = runs[number], np.log(sf[runs[number].at])
        fitted = a0[number] + a1[number] / mean
        _, mu, _ = _fit(y, offset, run.x, own)
        alpha = _best_dispersion(y, mu, run.x, max(10.0, float(len(run.at))), np.log(fitted), width[number])
        # A gene far above the trend keeps its own dispersion.
        alpha = np.where(np.log(own) > np.log(fitted) + 2 * np.sqrt(observed[number]), own, alpha)
        return alpha, *_fit(y, offset, run.x, alpha)

    def in_task(batches):
        for batch in batches:
            whole = count_matrix(batch, n)
            if not len(whole):
                continue
            means, disps = np.stack(batch["base_mean"]), np.stack(batch["disp_gene"])
            for number, run in enumerate(runs):
                counted = ~np.isnan(disps[:, number])
                if not counted.any():
                    continue
                y, factors, x = whole[counted][:, run.at], sf[run.at], run.x
                own, mean = disps[counted, number], means[counted, number]
                alpha, beta, mu, covariance = fitted_genes(number, y, mean, own)
                replaced, flagged, most = np.zeros(len(y), int), np.zeros(len(y), bool), np.full(len(y), np.nan)
                if method == "wald" and len(run.at) > x.shape[1]:
                    cells = Cells.in_design(x)
                    distance = cooks_distances(y, factors, x, mu, alpha, cells)
                    cut = outlier_cut(*x.shape)
                    out = (distance > cut) & (cells.size >= LEAST_REPLACED)
                    judged = (cells.size >= LEAST_JUDGED) & (cells.size < LEAST_REPLACED)
                    if judged.any():
                        worst = np.where(judged, distance, -1).argmax(axis=1)
                        most = distance[np.arange(len(y)), worst]
                        larger = (y > y[np.arange(len(y)), worst][:, None]).sum(axis=1)
                        flagged = (most > cut) & ~((larger >= LARGER_COUNTS) & (len(np.unique(cells.of)) == 2))
                    again = np.flatnonzero(out.any(axis=1))
                    if len(again):
                        replaced = out.sum(axis=1)
                        fill = np.floor(trimmed_mean(y[again] / factors, TRIMMED_MEAN)[:, None] * factors)
                        y = y.copy()
                        y[again] = np.where(out[again], fill, y[again])
                        again = again[y[again].sum(axis=1) > 0]
                        level, fresh = _own_dispersions(y[again], factors, x)
                        alpha[again], beta[again], mu[again], covariance[again] = fitted_genes(number, y[again], level, fresh)
                effect, se = beta[:, tested], np.sqrt(covariance[:, tested, tested])
                if method == "wald":
                    stat = effect / se
                    p = np.where(flagged | (y.sum(axis=1) == 0), np.nan, normal_sf2(stat))
                else:
                    _, mu0, _ = _fit(y, np.log(factors), np.delete(x, tested, axis=1), alpha)
                    stat = np.maximum(2 * (_loglik(y, mu, alpha) - _loglik(y, mu0, alpha)), 0)
                    p = chi2_sf(stat, 1.0)
                yield pd.DataFrame(
                    {
                        "run_id": run.name, "gene": batch["gene"][counted], "base_mean": mean, "log2fc": effect / LN2,
                        "lfc_se": se / LN2, "stat": stat, "pvalue": p, "n_replaced": replaced, "is_flagged": flagged, "max_cooks": most,
                    }
                )

    key = genes.rows.schema["gene"].dataType.simpleString()
    schema = f"run_id {run_type}, gene {key}, base_mean double, log2fc double, lfc_se double, stat double, pvalue double"
    return table.mapInPandas(in_task, schema + ", n_replaced int, is_flagged boolean, max_cooks double")


def _tested(
    counts: DataFrame, designs: DataFrame, group: str, methods: list[str], hidden: int = 0, covariates: list[str] | None = None,
    factors: DataFrame | None = None, alpha: float = FILTER_ALPHA,
) -> dict[str, DataFrame]:
    """Results by method, with ``n_replaced``, ``is_flagged`` and ``max_cooks``. The Wald and the plain likelihood-ratio test share packing,
    dispersions and hidden covariates, for all runs; ``edger`` has all of its own but the hidden covariates."""
    if not set(methods) <= {"wald", "lrt", "edger"}:
        raise ValueError(f"unknown method among {methods}")
    columns = [*(covariates or []), group]
    designs = materialize(designs.select("run_id", "sample", *columns), "designs")
    genes = pack_genes(counts, designs, factors)
    genes = replace(genes, rows=materialize(genes.rows, "gene-rows"))
    runs = designs_of(genes, designs, columns)
    if hidden:
        # The searches of the runs are independent chains of jobs.
        calls = [lambda r=run: hidden_directions(genes, r.at, r.x[:, -1], hidden) for run in runs]
        found = side_by_side(counts.sparkSession, calls)
        runs = [Run(r.name, r.at, np.column_stack([r.x[:, :-1], d, r.x[:, -1:]])) for r, d in zip(runs, found)]
    run_type = designs.schema["run_id"].dataType.simpleString()
    last = len(columns) + hidden
    table = gene_dispersions(genes, runs) if set(methods) & {"wald", "lrt"} else None
    results = {}
    for method in methods:
        if method == "edger":
            from cohortloom.operators import edger

            some = counts.join(designs.select("sample").distinct(), "sample", "left_semi")
            sizes = {r["sample"]: r["size_factor"] for r in edger.effective_sizes(some).collect()}  # one row a sample, as for the packing
            own = replace(genes, size_factors=np.array([sizes[s] for s in genes.samples]))
            tested = edger.ratio_tests(own, runs, last, run_type).withColumns(
                {"n_replaced": F.lit(0), "is_flagged": F.lit(False), "max_cooks": F.lit(None).cast("double")}
            )
        else:
            tested = _tests(genes, table, runs, last, method, run_type)
        tested = materialize(tested, "tests")
        adjusted = filtered_fdr(tested, "pvalue", "base_mean", ["run_id"], alpha) if method == "wald" else fdr_bh(tested, "pvalue", ["run_id"])
        results[method] = adjusted.select("run_id", *RESULT, "n_replaced", "is_flagged", "max_cooks")
    return results


def nb_test_runs(counts: DataFrame, designs: DataFrame, group: str, method: str = "wald", covariates: list[str] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """(run_id, gene, base_mean, log2fc, lfc_se, stat, pvalue, padj) of group 1 against group 0, for every run in one plan.

    ``counts`` is (gene, sample, cnt); ``designs`` is (run_id, sample, group, *covariates). Method ``wald`` or ``lrt``.
    P-values are adjusted within a run, for ``wald`` behind the chosen cut on ``base_mean``. Method ``edger`` is the other method of ``run_tests``.
    """
    return _tested(counts, designs, group, [method], covariates=covariates, factors=factors)[method].select("run_id", *RESULT)


def nb_test(counts: DataFrame, design: DataFrame, group: str, method: str = "wald", covariates: list[str] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """The test of a single grouping (sample, group, *covariates)."""
    return nb_test_runs(counts, design.withColumn("run_id", F.lit(0)), group, method, covariates, factors).drop("run_id")


def outliers(counts: DataFrame, design: DataFrame, group: str) -> DataFrame:
    """(gene, n_replaced, is_flagged, max_cooks) of the Wald test: counts replaced, whether the p-value was withheld, and the largest distance
    among counts that can be judged but not replaced."""
    found = _tested(counts, design.withColumn("run_id", F.lit(0)), group, ["wald"])["wald"]
    return found.select("gene", "n_replaced", "is_flagged", "max_cooks")


def run_tests(counts: DataFrame, designs: DataFrame, group: str, method: str, batch_removal: bool = False, hidden: int = 2) -> DataFrame:
    """Results of ``deseq2`` (Wald), ``edger`` (likelihood ratio) or ``all`` of them in one schema with a ``method`` column.

    ``batch_removal`` adds hidden covariates found in the counts to the design of every run.
    """
    kinds = {"deseq2": ["wald"], "edger": ["edger"], "all": ["edger", "wald"]}[method]
    names = {"wald": "deseq2", "edger": "edger"}
    found = _tested(counts, designs, group, kinds, hidden if batch_removal else 0)
    return union_all([df.select("run_id", *RESULT).withColumn("method", F.lit(names[kind])) for kind, df in found.items()])
