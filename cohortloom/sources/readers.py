"""Readers for the file kinds the analyses take in: delimited text, matrices, variants, JSON, XML, paged payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalar import interaction_text, null_if_nan, text_or_list
from cohortloom.operators.lists import first_per_key
from cohortloom.runtime import opened, union_all

INTERACTION_SCHEMA = (
    "matchedTerms array<struct<geneName:string, geneCategories:array<struct<name:string>>, "
    "interactions:array<struct<drugName:string, score:double, interactionTypes:array<string>>>>>"
)

#: Columns that a delimited file may have; Spark's own limit is 20,480.
MOST_COLUMNS = 1_000_000


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text with a header; a ``.gz`` file is read as it is. Columns are text unless ``schema`` is given.

    A single gzip file cannot be split and is read by one task, so its rows are dealt out again after the column choice.
    """
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="", maxColumns=MOST_COLUMNS)
    return dealt_out(df, df.select(*columns) if columns else df)


def dealt_out(read: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if ``read`` has a gzip file, which one task reads from end to end; else as they are."""
    spark = read.sparkSession
    return rows.repartition(spark.sparkContext.defaultParallelism) if any(f.endswith(".gz") for f in read.inputFiles()) else rows


def _header(spark: SparkSession, path: str) -> DataFrame:
    """(at, name) of the cells of a file's first line."""
    first = spark.read.text(path).limit(1)
    return first.select(F.posexplode(F.split("value", "\t")).alias("at", "name")).withColumn("name", F.regexp_replace("name", '^"|"$', ""))


def header_names(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """The column names of a wide file without its id column(s), one per row; only the first line is read."""
    return _header(spark, path).where(F.col("at") >= skip).select(F.col("name").alias("sample"))


def matrix_to_long(wide: DataFrame, id_column: str, samples: list[str] | None = None) -> DataFrame:
    """A feature-by-sample table as (sample, feature, value); missing cells and NaN become absent rows.

    One generator over an array of the cells: a row is read once however many samples there are.
    """
    wanted = samples if samples is not None else [c for c in wide.columns if c != id_column]
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in wanted])
    exploded = wide.select(F.col(f"`{id_column}`").alias("feature"), F.posexplode(cells).alias("at", "value"))
    names = F.array(*[F.lit(c) for c in wanted])
    return exploded.select(F.get(names, F.col("at")).alias("sample"), "feature", null_if_nan(F.col("value")).alias("value")).where(
        "value IS NOT NULL"
    )


def read_matrix(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """A wide matrix file as long rows; ``samples`` limits the columns taken.

    Lines are split once and their cells meet the names of the first line in a join, so neither the plan nor the driver grows
    with the samples and there is no limit on columns. Later files of a folder may repeat the first line.
    """
    lines = spark.read.text(path)
    header = _header(spark, path)
    names = header.where("at > 0").select("at", F.col("name").alias("sample"))
    if samples is not None:
        names = names.join(spark.createDataFrame([(s,) for s in samples], "sample string"), "sample", "left_semi")
    corner = header.where("at = 0").select(F.col("name").alias("corner"))
    cells = dealt_out(lines, lines).select(F.split("value", "\t").alias("cells"))
    rows = cells.select(F.regexp_replace(F.col("cells")[0], '^"|"$', "").alias("feature"), F.posexplode("cells").alias("at", "cell")).where("at > 0")
    long = rows.join(corner, F.col("feature") == F.col("corner"), "left_anti").join(names, "at")
    return long.select("sample", "feature", null_if_nan(F.expr("try_cast(cell AS double)")).alias("value")).where("value IS NOT NULL")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Variant text: tab-separated, ``#`` comment lines, header; the three columns every analysis uses."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    kept = df.select(
        F.col("Tumor_Sample_Barcode").alias("tumor_sample_barcode"),
        F.col("Hugo_Symbol").alias("hugo_symbol"),
        F.col("Variant_Classification").alias("variant_classification"),
    )
    return dealt_out(df, kept)


def read_interactions(documents: DataFrame, column: str) -> DataFrame:
    """One row per matched gene of each drug-interaction document."""
    parsed = documents.select(F.explode(F.from_json(F.col(column), INTERACTION_SCHEMA)["matchedTerms"]).alias("term"))
    return interaction_rows(parsed.select("term.*"))


def interaction_rows(terms: DataFrame) -> DataFrame:
    """Gene, categories, ``drug;score;types`` joined by ``&``, the same as a list, and the count.

    The count is ``interactionCount`` where the terms have it, as those of a gene that fills several terms do.
    """

    def text(one: Column) -> Column:
        return interaction_text(one["drugName"], one["score"], one["interactionTypes"])

    listed = F.transform("interactions", text)
    count = F.col("interactionCount") if "interactionCount" in terms.columns else F.size("interactions")
    return terms.select(
        F.col("geneName").alias("gene"),
        F.array_join(F.transform("geneCategories", lambda c: c["name"]), ",").alias("categories"),
        F.array_join(listed, "&").alias("interactions_text"),
        listed.alias("interactions_list"),
        count.alias("n_interactions"),
    )


def read_json_records(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> DataFrame:
    """JSON arrays of records, one row per record; an array fills a file or, for staged batches, a line."""
    return spark.read.schema(schema).json(path, multiLine=whole_file)


def structure_records(records: DataFrame, taxid: int = 9606) -> DataFrame:
    """Gene, joined structure ids and their count; ``pdb`` is a text or a list of texts."""
    joined, count = text_or_list(F.col("pdb"))
    kept = records.where((F.col("taxid") == taxid) & F.col("pdb").isNotNull())
    return kept.select(F.col("query").alias("gene"), joined.alias("pdb_ids"), count.alias("pdb_count"))


def read_xml_entries(spark: SparkSession, path: str, schema: str, row_tag: str = "entry") -> DataFrame:
    """The entries of many XML documents as one table."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_paged_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All pages of a paged TSV result; every page repeats the header, which Spark drops per file."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_paged_json(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """``results`` and ``failedIds`` of all pages of a paged JSON result, flattened; a page fills a file or a line."""
    pages = spark.read.schema(schema).json(path, multiLine=whole_file)
    results = pages.select(F.explode("results").alias("r")).select("r.*")
    failed = pages.select(F.explode("failedIds").alias("failed_id"))
    return results, failed


def read_payload(spark: SparkSession, path: str, kind: str, schema: str, whole_file: bool = True) -> DataFrame:
    """Staged payload files of one kind; Spark unpacks ``.gz`` names by itself."""
    if kind == "json":
        return read_json_records(spark, path, schema, whole_file)
    if kind == "tsv":
        return read_paged_tsv(spark, path, schema)
    if kind == "xml":
        return read_xml_entries(spark, path, schema)
    if kind == "text":
        return spark.read.text(path)
    raise ValueError(f"unknown payload kind {kind}")


def read_sample_files(spark: SparkSession, pattern: str, manifest: DataFrame, schema: str) -> DataFrame:
    """One folder with an expression file per sample, keyed through the manifest (``id``, ...) by folder name."""
    rows = spark.read.csv(pattern, sep="\t", header=True, schema=schema)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select("*", F.regexp_replace(folder, "^.*=", "").alias("id")).join(manifest, "id")


def key_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key to its first value (smallest, so that the choice does not hang on file order)."""
    return first_per_key(df.select(key, value).where(F.col(value).isNotNull()), [key], [value])


def jdbc_options(source: str, bounds: tuple[str, int, int, int] | None = None, **given) -> dict:
    """Options of a JDBC read of a table or of a bracketed query with an alias.

    ``bounds`` (column, lowest, highest, number) reads it over so many connections; without, one task reads it all.
    """
    if bounds is None:
        return {"dbtable": source, **given}
    column, low, high, number = bounds
    return {"dbtable": source, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(number), **given}


def read_db_table(spark: SparkSession, name: str, first: str = "gene", bounds: tuple[str, int, int, int] | None = None, **jdbc) -> DataFrame:
    """A database table (JDBC options from the caller) or, without options, a catalog table; columns get its name as prefix."""
    df = spark.read.format("jdbc").options(**jdbc_options(name, bounds, **jdbc)).load() if jdbc else spark.table(name)
    return df.toDF(first, *[f"{name}_{c}" for c in df.columns[1:]])


def read_db_query(spark: SparkSession, text: str, bounds: tuple[str, int, int, int] | None = None, **jdbc) -> DataFrame:
    """The rows of a SQL text, from a database if JDBC options are given, else from the catalog."""
    return spark.read.format("jdbc").options(**jdbc_options(f"({text}) AS q", bounds, **jdbc)).load() if jdbc else spark.sql(text)


#: Bytes of a file that a task holds at a time while it takes the digest.
DIGEST_BYTES = 8_000_000


def file_digests(files: DataFrame) -> DataFrame:
    """(filename, md5, size) of the files of a ``binaryFile`` frame, each gone through in pieces by one task.

    Tasks open the files by their paths. In a store that they cannot open (the driver tries one file of each), Spark reads the content, a file at once.
    """
    name, store = F.element_at(F.split("path", "/"), -1).alias("filename"), F.regexp_extract("path", "^[^/]*(//[^/]*)?", 0)
    first = files.groupBy(store.alias("store")).agg(F.min("path").alias("path")).collect()  # a row for each store
    closed = [row["store"] for row in first if not _opens(row["path"])]
    parts = []
    if len(closed) < len(first) or not first:
        listed = files.where(~store.isin(closed)) if closed else files
        parts.append(listed.select("path", name, "length").mapInArrow(_digests, "filename string, md5 string, size long"))
    if closed:
        parts.append(files.where(store.isin(closed)).select(name, F.md5("content").alias("md5"), F.col("length").alias("size")))
    return union_all(parts)


def _opens(path: str) -> bool:
    try:
        where, at = opened(path)
        with where.open_input_stream(at, compression=None):
            return True
    except (OSError, ValueError, NotImplementedError):
        return False


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = []
        for path in batch["path"].to_pylist():
            where, at = opened(path)
            digest, piece = hashlib.md5(usedforsecurity=False), bytearray(DIGEST_BYTES)
            with where.open_input_stream(at, compression=None) as stream:
                while n := stream.readinto(piece):
                    digest.update(memoryview(piece)[:n])
            seen.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["filename"], pa.array(seen, pa.string()), batch["length"]], ["filename", "md5", "size"])


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows with the state of their file: validated, missing, or wrong size or content.

    ``files`` comes from the ``binaryFile`` reader; only digest and length leave the scan.
    """
    seen = file_digests(files).select("filename", F.col("md5").alias("seen_md5"), F.col("size").alias("seen_size"))
    state = (
        F.when(F.col("seen_md5").isNull(), "missing")
        .when(F.col("seen_size") != F.col("size"), "wrong size")
        .when(F.col("seen_md5") != F.col("md5"), "wrong content")
        .otherwise("validated")
    )
    return manifest.join(seen, "filename", "left").withColumn("state", state)
