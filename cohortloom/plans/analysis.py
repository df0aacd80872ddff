"""Choice of the best runs from the score history, and the differential analysis built on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import sample_type
from cohortloom.operators.annotate import annotate_genes
from cohortloom.operators.diffexp import consensus, two_sided_effect, wide_by_run
from cohortloom.operators.nbtest import run_tests
from cohortloom.operators.ordered import quantiles, with_row
from cohortloom.operators.survival import km_summary
from cohortloom.runtime import materialize
from cohortloom.sources.writers import result_name, write_sorted

F1_PAIRS = [("rna_anova", "rna_rf"), ("mirna_anova", "mirna_rf"), ("meth_anova", "meth_rf")]


@dataclass(frozen=True)
class RunChoice:
    """Rules for a good run; the defaults are the ones the analysis has always used."""

    silhouette_quantile: float = 0.5
    f1_quantile: float = 0.7
    p_limit: float = 0.05
    draw: int = 100
    seed: int = 331


def score_thresholds(scores: DataFrame, choice: RunChoice = RunChoice()) -> DataFrame:
    """One row: the silhouette and F1 quantiles of the whole score table, as ``q_<score>`` columns."""
    f1 = [name for pair in F1_PAIRS for name in pair]
    names = ["silhouette", *f1]
    long = scores.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).cast("double").alias("value")) for n in names])
        ).alias("s")
    ).select("s.score", "s.value")
    both = quantiles(long, ["score"], "value", {"mid": choice.silhouette_quantile, "high": choice.f1_quantile})
    return both.agg(
        *[
            F.max(F.when(F.col("score") == n, F.col("mid" if n == "silhouette" else "high"))).alias(f"q_{n}")
            for n in names
        ]
    )


def passes(choice: RunChoice = RunChoice()) -> Column:
    """Row predicate over scores joined with their thresholds; a null score does not pass."""
    good = (
        (F.col("silhouette") >= F.col("q_silhouette"))
        & (F.col("log_rank_p") < choice.p_limit)
        & (F.col("tmb_p") < choice.p_limit)
    )
    for anova, forest in F1_PAIRS:
        good = good & ((F.col(anova) >= F.col(f"q_{anova}")) | (F.col(forest) >= F.col(f"q_{forest}")))
    return good


def filter_best_runs(scores: DataFrame, choice: RunChoice = RunChoice()) -> DataFrame:
    return with_row(scores, score_thresholds(scores, choice)).where(passes(choice)).select(*scores.columns)


def sample_k_seeded(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows by a seeded hash of the key, the same rows on every engine; all rows if there are fewer."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return df.orderBy(draw, key).limit(k)


def select_best_subgroups(scores: DataFrame, choice: RunChoice = RunChoice()) -> DataFrame:
    """Runs past every threshold, at most ``draw`` of them by seeded draw, best silhouette first."""
    drawn = sample_k_seeded(filter_best_runs(scores, choice), "run_id", choice.draw, choice.seed)
    return drawn.orderBy(F.desc("silhouette"), "run_id")


# --------------------------------------------------------------------------- differential analysis of the chosen runs


@dataclass(frozen=True)
class DiffChoice:
    """Method and cuts of the differential analysis."""

    method: str = "deseq2"
    log2fc: float = 1.0
    fdr: float = 0.05
    normal_p: float = 0.1
    batch_removal: bool = True


def oriented_groups(groups: DataFrame, survival: DataFrame) -> DataFrame:
    """(run_id, sample, group) with 0 and 1 swapped in the runs whose group 0 is not the longer survivor."""
    joined = groups.join(survival.select("sample", "os", "os_time"), "sample", "left")
    both = joined.withColumn("side", F.struct("run_id", F.col("group").alias("g")))
    summary = km_summary(both, "side", "os_time", "os")
    flags = summary.groupBy(F.col("grp.run_id").alias("run_id")).agg(
        F.max(F.when(F.col("grp.g") == 0, F.col("rmst"))).alias("rmst_0"),
        F.max(F.when(F.col("grp.g") == 1, F.col("rmst"))).alias("rmst_1"),
    )
    swap = F.coalesce(~(F.col("rmst_0") > F.col("rmst_1")), F.lit(True))
    return groups.join(flags, "run_id").select(
        "run_id", "sample", F.when(swap, 1 - F.col("group")).otherwise(F.col("group")).alias("group")
    )


def subgroup_consensus(counts: DataFrame, groups: DataFrame, choice: DiffChoice = DiffChoice()) -> tuple[DataFrame, DataFrame]:
    """Cut results of all runs in long form, and the consensus over the runs per gene."""
    tested = run_tests(counts, groups, "group", choice.method, choice.batch_removal)
    cut = materialize(two_sided_effect(tested, choice.log2fc, choice.fdr), "cut")
    runs = groups.select("run_id").distinct().count()
    return cut, consensus(cut, runs * (2 if choice.method == "all" else 1))


def tumor_normal(counts: DataFrame, barcode: str, choice: DiffChoice = DiffChoice()) -> DataFrame:
    """(gene, nt_tp_log2fc, nt_tp_pvalue) of tumour against normal tissue by the barcode's sample code."""
    kind = sample_type(F.col(barcode))
    design = counts.select(F.col(barcode).alias("sample"), F.when(kind == "TP", 1).when(kind == "NT", 0).alias("group"))
    cells = counts.select("gene", F.col(barcode).alias("sample"), "cnt")
    design = design.where("group IS NOT NULL").distinct().withColumn("run_id", F.lit(0))
    tested = run_tests(cells, design, "group", "deseq2", choice.batch_removal)
    cut = two_sided_effect(tested, 0.0, choice.normal_p, p="pvalue")
    return cut.select("gene", F.col("log2fc").alias("nt_tp_log2fc"), F.col("pvalue").alias("nt_tp_pvalue"))


def analysis_table(cut: DataFrame, summary: DataFrame, runs: list, normal: DataFrame, annotations: list[DataFrame]) -> DataFrame:
    """The final table: per-run columns, consensus, tumour against normal, and all annotations, by gene."""
    wide = wide_by_run(cut, runs, {"log2FoldChange": "log2fc", "padj": "padj"})
    return annotate_genes(wide.join(summary, "gene"), [normal, *annotations])


def text_mining(tables: dict[str, DataFrame]) -> DataFrame:
    """Text-mining tables of one or more cohorts, outer-joined on gene; every column keeps its table's name."""
    named = [df.toDF("gene", *[f"{name}_{c}" for c in df.columns[1:]]) for name, df in tables.items()]
    return reduce(lambda left, right: left.join(right, "gene", "full"), named)


def write_analysis(table: DataFrame, base: str, cohort: str, seed: int, moment) -> str:
    """The final table as CSV ordered by gene; its path carries cohort, seed and time."""
    path = f"{base}/RESULT/{cohort}/{result_name(cohort, seed, moment)}"
    write_sorted(table, path)
    return path
