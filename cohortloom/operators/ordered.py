"""Running totals, ranks and exact quantiles that never put an unbounded group into one task.

A window without a bound on its partition sorts the whole partition in one task. Here the input is
first reduced to one row per (key, position) and written. If the written table is small, one window
does the work. If not, the order is cut into ranges: a window inside each range, a second one over
the few range totals, and a join of the two. The cut points come from a hash sample and only decide
how the work is spread; every row takes part in the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.runtime import materialize

ROWS_PER_WINDOW = 1_000_000
CUT_SAMPLE = 20_000
MOST_RANGES = 2_000  # beyond that a range is a sort that spills, not a larger plan

_AGGREGATES = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}
_IDENTITY = {"sum": 0, "product": 1.0}


@dataclass(frozen=True)
class OrderPlan:
    """How a written table is spread: no cut points means that one window per key is small enough."""

    rows: int
    cuts: list = field(default_factory=list)


def plan_order(written: DataFrame, order: list[str], rows_per_window: int | None = None) -> OrderPlan:
    """Size and, for a large table, cut points of a table that is cheap to read again."""
    rows_per_window = rows_per_window or ROWS_PER_WINDOW
    rows = written.count()
    if rows <= rows_per_window:
        return OrderPlan(rows)
    ranges = min(MOST_RANGES, max(2, ceil(2 * rows / rows_per_window)))
    step = max(1, ceil(rows / CUT_SAMPLE))
    sample = written.where(F.pmod(F.xxhash64(*order), F.lit(step)) == 0).select(*order).distinct()
    picked = sorted(tuple(row) for row in sample.collect())
    stride = max(1, len(picked) // ranges)
    return OrderPlan(rows, picked[stride::stride])


def range_number(df: DataFrame, order: list[str], cuts: list) -> Column:
    """How many cut points are not above the row, by comparison of the ``order`` columns as one struct.

    The cut points are looked up in two levels, so a row is compared with about twice the root of their number.
    """
    here = F.struct(*[F.col(c) for c in order])
    types = [df.schema[c].dataType for c in order]
    edges = [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, cut, types)]) for cut in cuts]
    width = max(1, isqrt(len(edges)))
    blocks = [edges[start : start + width] for start in range(0, len(edges), width)]

    def not_above(group: list[Column] | Column) -> Column:
        return F.size(F.filter(group if isinstance(group, Column) else F.array(*group), lambda edge: edge <= here))

    block = not_above([b[0] for b in blocks])
    inside = not_above(F.get(F.array(*[F.array(*b) for b in blocks]), block - 1))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which has exactly one row, to every row of ``df``."""
    one = F.lit(1)
    return df.withColumn("_one_row", one).join(F.broadcast(row.withColumn("_one_row", one)), "_one_row").drop("_one_row")


def _joined(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + inside
    if kind == "product":
        return F.coalesce(before, F.lit(1.0)) * inside
    return (F.least if kind == "min" else F.greatest)(before, inside)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, str]],
    reverse: bool = False,
    plan: OrderPlan | None = None,
    rows_per_window: int | None = None,
) -> DataFrame:
    """Add running aggregates, from the first row to the current one (or from the last one if ``reverse``).

    ``df`` needs one row per (keys, order) and no null among the ``order`` columns.
    ``measures`` maps an output name to (kind, input column) with kind sum, product, min or max;
    ``sum_before`` and ``product_before`` leave out the current row. With a ``plan`` the caller says
    that ``df`` is cheap to compute again and how to spread it.
    """
    if plan is None:
        df = materialize(df, "ordered")
        plan = plan_order(df, order, rows_per_window)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]

    def along(partition: list[str], measure: str, column: str) -> Column:
        kind, _, before = measure.partition("_")
        frame = Window.partitionBy(*partition).orderBy(*direction).rowsBetween(
            Window.unboundedPreceding, -1 if before else 0
        )
        value = _AGGREGATES[kind](column).over(frame)
        return F.coalesce(value, F.lit(_IDENTITY[kind])) if before else value

    if not plan.cuts:
        return df.withColumns({out: along(keys, kind, col) for out, (kind, col) in measures.items()})

    kinds = {out: kind.partition("_")[0] for out, (kind, _) in measures.items()}
    ranged = df.withColumn("_range", range_number(df, order, plan.cuts))
    totals = ranged.groupBy(*keys, "_range").agg(
        *[_AGGREGATES[kinds[out]](col).alias(f"_all_{out}") for out, (_, col) in measures.items()]
    )
    next_range = F.col("_range").desc() if reverse else F.col("_range").asc()
    earlier = Window.partitionBy(*keys).orderBy(next_range).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        "_range",
        *[_AGGREGATES[kinds[out]](f"_all_{out}").over(earlier).alias(f"_before_{out}") for out in measures],
    )
    inside = ranged.withColumns(
        {f"_in_{out}": along([*keys, "_range"], kind, col) for out, (kind, col) in measures.items()}
    )
    same = inside.alias("i").join(
        before.alias("b"), on=[F.col(f"i.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_range"]], how="inner"
    )
    return same.select(
        *[F.col(f"i.{c}") for c in df.columns],
        *[_joined(kinds[out], F.col(f"_before_{out}"), F.col(f"_in_{out}")).alias(out) for out in measures],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", **options) -> DataFrame:
    """Row number from 1 within ``keys`` by ``order``, which must be a total order."""
    counted = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {out: ("sum", "_one")}, **options)
    return counted.drop("_one")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], **options) -> DataFrame:
    """Exact quantiles with linear interpolation per ``keys``; null values do not count.

    Equal values are counted before the shuffle, so a hot key costs its distinct values, not its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted_quantiles(counts, keys, value, probabilities, **options)


def counted_quantiles(counts: DataFrame, keys: list[str], value: str, probabilities: dict[str, float | Column], **options) -> DataFrame:
    """``quantiles`` of values that come with how often they occur (``_n``), one row for each; a probability may be a column."""
    ranked = running(counts, keys, [value], {"_upto": ("sum", "_n")}, **options)
    # The two positions around each probability need the group size: one row per key.
    sizes = ranked.groupBy(*keys).agg(F.max("_upto").alias("_size"))
    sized = ranked.join(sizes, keys) if keys else with_row(ranked, sizes)
    outputs = []
    for name, p in probabilities.items():
        position = (p if isinstance(p, Column) else F.lit(float(p))) * (F.col("_size") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(position), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value)))
        share = F.max(position - F.floor(position))
        outputs.append((low + (high - low) * share).alias(name))
    return sized.groupBy(*keys).agg(*outputs)
