"""Mixing sources to target weights, each source cut exactly at its budget.

Every text gets a hash-random key. Within each source the texts are sorted by it, in ranges of the key of bounded size; the sums
of the ranges, then the sums inside each range, give every text the number of words before it. A source whose budget is more
than its size repeats whole epochs first; the rest of the budget is cut at the exact word, so one text of a source may be taken
in part. Nothing depends on the number of tasks, so reruns agree.

Null sources are a source of their own, sorted last; null texts have size 0 and nothing taken. Rows equal in source, id and
size are ordered by their place, which cannot be told apart in the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.llm.common import step, stored
from cohortloom.llm.sqltext import n_words, words

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input; the most often a source may be repeated.
SHARE, EPOCHS = 1.5, 2
#: Texts of a range of keys, about.
RANGE_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row a source, so plain windows do.

    A target is weight x level, at most ``epochs`` times the source's size. Sources in the order of size for weight reach
    their limit one after the other; the level is the rest of the budget over the rest of the weights at the first that does not.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = sizes.select("source", "source_size", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("place"))
    limits = placed.withColumn("weight", weight).withColumn("most", epochs * F.col("source_size"))
    by_need = W.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    levels = limits.withColumn("level", level)
    open_ = F.col("level") < F.col("most") / F.col("weight")
    chosen = levels.withColumn("chosen", F.first(F.when(open_, F.col("level")), ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("most").cast("double")))
    return chosen.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix",
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``row, doc_id, size, source_size, target, taken`` for every text of a stored table."""
    docs = stored(docs, True)
    size = n_words(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    sized = step(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").alias("source"), size.alias("size"),
        ).withColumn("key", F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))),
        "sizes",
    )
    ranges = max(1, -(-sized.count() // range_rows))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * ranges).cast("int")
    keyed = sized.withColumn("part", part)
    sums = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sums = sums.withColumn("part_before", F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, epochs)
    goals = sums.alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source")).select(
        F.col("s.source").alias("of_source"), F.col("part").alias("of_part"), "part_before", "source_size", "target"
    )
    in_part = W.partitionBy("source", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    both = placed.join(goals, F.expr("source <=> of_source AND part = of_part"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - rounds * F.col("source_size")).cast("long")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("part_before") - F.col("before")))
    return both.select(
        "row", "doc_id", "size", "source_size", "target",
        F.least(epochs * F.col("size"), rounds * F.col("size") + cut).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, text_col: str = "text", is_stored: bool = False, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for every epoch that takes the text. The last one may hold the text's first words only,
    joined by one space. The other columns are those of ``docs``."""
    source = stored(docs, is_stored)
    taken = plan(source, text_col=text_col, **options).select("row", "size", "taken").filter("taken > 0")
    rows = source.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")).join(taken, "row")
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words_left = (F.col("taken") - (F.col("part") - 1) * F.col("size")).cast("int")
    text = F.col("doc")[text_col]
    cut = F.when(words_left >= F.col("size"), text).otherwise(F.array_join(F.slice(words(text), F.lit(1), words_left), " "))
    return each.select(*[cut.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
