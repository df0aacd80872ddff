"""Joins and list aggregates of the analyses that are more than one DataFrame call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import RUN_ID, matched
from cohortloom.operators.lists import collected_parts
from cohortloom.runtime import union_all


def pending_runs(groups: DataFrame, done: DataFrame) -> DataFrame:
    """Run ids of group files for which no result file is there yet."""
    wanted = groups.select(matched(F.col("file"), RUN_ID).alias("run_id")).where("run_id IS NOT NULL").distinct()
    finished = done.select(matched(F.col("file"), RUN_ID).alias("run_id"))
    return wanted.join(finished, "run_id", "left_anti")


def inner_fold(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner join of wide frames on one key, for frames whose columns differ."""
    return reduce(lambda left, right: left.join(right, key), frames)


def outer_by_union(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer join of many (key, value) frames as one union and one aggregate; a column per frame."""
    named = [df.select(key, F.lit(name).alias("_from"), value) for name, df in frames.items()]
    return union_all(named).groupBy(key).pivot("_from", list(frames)).agg(F.first(value, ignorenulls=True))


def outer_from_long(df: DataFrame, key: str, column: str, value: str, names: dict) -> DataFrame:
    """The same full outer join where the frames are slices of one long table by ``column``: one scan, one aggregate.

    ``names`` gives the output column of each value of ``column``; other values take no part.
    """
    wide = df.where(F.col(column).isin(list(names))).groupBy(key).pivot(column, list(names)).agg(F.first(value, ignorenulls=True))
    return wide.select(key, *[F.col(f"`{v}`").alias(name) for v, name in names.items()])


def full_outer_pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full")


def left_chain(base: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """Left joins in order; repeated keys on the right multiply rows. AQE broadcasts the tables that prove small."""
    return reduce(lambda left, right: left.join(right, key, "left"), tables, base)


def join_without_missing(frames: list[DataFrame | None], key: str) -> DataFrame:
    """Inner join of the frames that are there."""
    return inner_fold([df for df in frames if df is not None], key)


def multimap(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """Key to the values of all frames, in frame order; long lists continue in further parts."""
    numbered = [df.select(key, F.struct(F.lit(i).alias("frame"), F.col(value).alias("v")).alias("entry")) for i, df in enumerate(frames)]
    parts = collected_parts(union_all(numbered), [key], "entries", F.col("entry"))
    return parts.select(key, "part", F.transform("entries", lambda e: e["v"]).alias("values"))


def joined_text(df: DataFrame, key: str, value: str, separator: str = ";") -> DataFrame:
    """Distinct non-empty values of each key, sorted and joined, with their number; a long list goes on in further parts, all
    with the number of the whole key."""
    kept = df.where(F.col(value).isNotNull() & (F.col(value) != "")).select(key, value).distinct()
    parts = collected_parts(kept, [key], "items", F.col(value), total="n")
    return parts.select(key, "part", F.array_join("items", separator).alias("joined"), "n")
