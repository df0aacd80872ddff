"""Helpers the operators share: row numbers, batches of bounded size, and release of finished shuffles."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.runtime import materialize

#: Words as all operators see them; Python's, Spark's and DuckDB's expressions read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes a task works on at a time.
SLICE_BYTES = 500_000


def stored(df: DataFrame, is_stored: bool) -> DataFrame:
    """``df`` such that reading it twice gives the same rows in the same partitions.

    That holds for a plain scan of files (``is_stored``), so row numbers taken on it repeat when a lost task runs again or a
    later job reads anew. Anything else is written to the shared folder first. File splits also hang on the number of cores
    that happen to be there; the number of now is kept for the session, so executors may come and go.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df if is_stored else materialize(df, "input")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``row`` of a stored table, whatever else it has."""
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, cut so that a slice holds about ``most`` bytes of ``column`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0)).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(ends.searchsorted(before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps whose frames are no longer held."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)  # sessions without a JVM of their own leave it to their server
    if jvm is not None:
        jvm.System.gc()


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder; the shuffles behind it may go."""
    spark = df.sparkSession
    out = materialize(df, name)
    del df  # a frame that is still held keeps its shuffles
    for _ in range(2):  # the first round only frees what holds the finished job; its shuffles go in the second
        release(spark)
    return out
