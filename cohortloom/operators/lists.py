"""Lists per key in parts of bounded length, and the first row per key, without sorting a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_LENGTH = 100_000


def collected_parts(
    df: DataFrame, keys: list[str], name: str, value: Column, part_length: int = PART_LENGTH, total: str | None = None
) -> DataFrame:
    """One sorted list per key, or several rows (``part`` 0, 1, ...) for a key with more than ``part_length`` values.

    ``total`` names a column with the number of values of the whole key, the same in all its rows.

    Equal values are counted before the shuffle and written out again at the end, so a value that fills a key travels as one
    row. Rows spread over the parts by hash. Nulls are left out, as by ``collect_list``.
    """
    length = F.lit(part_length)
    counted = (
        df.select(*keys, value.alias("_value")).where(F.col("_value").isNotNull()).groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    )
    sizes = counted.groupBy(*keys).agg(F.ceil(F.sum("_n") / length).alias("_parts"), F.sum("_n").alias("_total"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / length))))
    times = F.least(length.cast("long"), F.col("_n") - F.col("_piece") * length).cast("int")
    part = F.pmod(F.xxhash64("_value", "_piece"), F.col("_parts")).cast("int")
    spread = pieces.join(sizes, keys).select(*keys, "_value", times.alias("_times"), part.alias("part"), "_total")
    lists = spread.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct("_value", "_times"))).alias("_list"), F.max("_total").alias("_total")
    )
    whole = F.flatten(F.transform("_list", lambda e: F.array_repeat(e["_value"], e["_times"])))
    return lists.select(*keys, "part", whole.alias(name), *([F.col("_total").alias(total)] if total else []))


def one_row_per_key(parts: DataFrame, key: str, texts: list[str], separator: str = ";") -> DataFrame:
    """Rows of several parts joined into one per key, texts in the order of the parts; other columns are equal in all parts.

    For tables that are joined to others by the key, where further rows would multiply the rows of the others.
    """
    rest = [c for c in parts.columns if c not in (key, "part", *texts)]
    pieces = F.sort_array(F.collect_list(F.struct("part", *texts))).alias("_pieces")
    merged = parts.groupBy(key).agg(pieces, *[F.max(c).alias(c) for c in rest])

    def text(name: str) -> Column:
        found = F.filter(F.transform("_pieces", lambda p: p[name]), lambda t: t != "")
        return F.array_join(found, separator).alias(name)

    return merged.select(*[F.col(c) if c == key or c in rest else text(c) for c in parts.columns if c != "part"])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a minimum over structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    smallest = F.min(F.struct(*order, *rest)).alias("_row")
    picked = df.groupBy(*keys).agg(smallest)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
