"""Session-level helpers: scratch folder, written intermediates, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import ceil

import pyarrow.fs
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition that a task sorts or groups in memory.
ROWS_PER_PARTITION = 500_000

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on this machine alone may
    fall back to a temporary folder, because other executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/") + "/cohortloom"
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="cohortloom-")
    return _local_scratch[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no earlier call has returned, in this application's part of the scratch folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme Hadoop gives it, so that tasks that open files by themselves mean the same place as Spark."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a qualified URI; local files come as ``file:/path``, S3 under its Hadoop name."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def materialize(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote as intermediates; call it when no result that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows; reads at most one more than that."""
    return df.limit(rows + 1).count() <= rows


def partitions_for(written: DataFrame) -> int:
    """Partitions that hold no more than ``ROWS_PER_PARTITION`` rows of a table on average, and no fewer than Spark's own number."""
    spark = written.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(written.count() / ROWS_PER_PARTITION))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column missing in one of them is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def side_by_side(spark: SparkSession, calls: list[Callable], at_once: int = 8) -> list:
    """Results of independent calls that each submit Spark jobs, run from a few threads."""
    in_session = inheritable_thread_target(spark)
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(in_session(call)) for call in calls]]
