"""Writers: delimited tables, the growing score table, snapshots, the modality bundle, models."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortloom.functions.scalar import RUN_ID_FORMAT
from cohortloom.runtime import partitions_for


def write_tsv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.csv(path, sep="\t", header=True, compression=compression or "none", nullValue="")


def write_first_column(df: DataFrame, path: str) -> None:
    """Only the first column, as the gene list that goes with a result table."""
    write_tsv(df.select(df.columns[0]), path)


def append_scores(scores: DataFrame, path: str) -> None:
    """Add the score rows of one or more runs to the table at ``path``, all or none; rows of a run that is there already are replaced.

    The rows go to a folder of their own, and a marker that names it is put in place last: until then ``read_scores`` sees the table as
    it was, and an attempt that failed before leaves nothing behind but its folder.
    """
    part = uuid.uuid4().hex
    scores.write.parquet(f"{path}/part={part}")
    _put_text(scores.sparkSession, f"{path}/_commits/{time.time_ns():020d}", part)


def read_scores(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed rows of the table, of each run those that were committed last."""
    if not path_exists(spark, f"{path}/_commits"):
        return spark.createDataFrame([], schema)
    commits = spark.read.text(f"{path}/_commits", wholetext=True).select(F.input_file_name().alias("name"), "value")
    order = sorted((row["name"].rsplit("/", 1)[-1], row["value"]) for row in commits.collect())  # one row an append
    parts = spark.createDataFrame([(part, at) for at, (_, part) in enumerate(order)], "part string, _at long")
    rows = spark.read.schema(StructType([*schema.fields, StructField("part", StringType())])).parquet(path).join(parts, "part")
    last = F.max("_at").over(Window.partitionBy("run_id"))
    kept = rows.repartition(partitions_for(rows), "run_id").withColumn("_last", last).where(F.col("_at") == F.col("_last"))
    return kept.select(*schema.names)


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all: written beside its place and renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = hadoop.Path(target.getParent(), f"_{target.getName()}")  # readers pass over names that begin so
    out = files.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(beside, target):
        raise OSError(f"cannot rename {beside} to {target}")


def write_sorted(df: DataFrame, path: str, by: str = "gene") -> None:
    """A total order over the part files: range partitions, sorted inside. A hash of the row splits a repeated key."""
    spread = df.repartitionByRange(F.col(by), F.xxhash64(*df.columns))
    spread.sortWithinPartitions(by).write.csv(path, header=True)


def result_name(cohort: str, seed: int, moment) -> str:
    """File name of a final table: cohort, seed and time."""
    formats = {"yyyyMMdd-HHmmss": "%Y%m%d-%H%M%S"}
    return f"{cohort}-RandomSeed-{seed}-{moment.strftime(formats[RUN_ID_FORMAT])}.csv"


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def snapshot(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the snapshot at ``path``; build and write it first if it is missing or was not finished."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bundle(matrix: DataFrame, path: str) -> None:
    """All modalities as one table with a folder per modality, so a reader of one skips the rest."""
    matrix.write.partitionBy("modality").parquet(path)
