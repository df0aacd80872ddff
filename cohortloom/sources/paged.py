"""A data source over staged pages: tab-separated files of some rows, each with its header, listed with their ranges in a manifest.

    register(spark)
    rows.write.format("pages").option("path", qualified(spark, path)).option("rows_per_page", 500).mode("append").save()
    spark.read.format("pages").option("path", qualified(spark, path)).load().where("key > 100")

The manifest is put in place when all tasks are done, so a reader sees a whole table or none; what a failed attempt wrote is never
listed. A reader drops pages whose ranges show that a pushed filter holds for none of their rows, and reads runs of pages, a
partition each; Spark applies the filters again to the rows. Null is an empty field; text is quoted, so empty text stays itself.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import compute, csv
from pyarrow.fs import FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortloom.runtime import opened

MANIFEST, ROWS_PER_PAGE, PAGES_PER_RUN = "_manifest.json", 10_000, 16


@dataclass
class Run(InputPartition):
    pages: list[str]


@dataclass
class Written(WriterCommitMessage):
    pages: list[dict]


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType:
        return StructType.fromJson(_manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PagedWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``pages`` known; filters reach its reader if the session lets them."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _manifest(path: str) -> dict:
    files, root = opened(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def may_hold(page: dict, filter_: Filter) -> bool:
    """False if the page's ranges show that the filter holds for no row."""
    column = getattr(filter_, "attribute", ("",))
    found = page["ranges"].get(column[0]) if len(column) == 1 else None
    if found is None:
        return True
    low, high = found["min"], found["max"]
    if low is None:  # nulls only
        return not isinstance(filter_, (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
    tests = {
        EqualTo: lambda: low <= filter_.value <= high, In: lambda: any(low <= v <= high for v in filter_.value if v is not None),
        GreaterThan: lambda: high > filter_.value, GreaterThanOrEqual: lambda: high >= filter_.value,
        LessThan: lambda: low < filter_.value, LessThanOrEqual: lambda: low <= filter_.value,
    }
    test = tests.get(type(filter_))
    return test is None or test()


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.run = int(options.get("pages_per_run", PAGES_PER_RUN))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = list(filters)
        yield from filters  # ranges are of whole pages, so every row is still looked at

    def pages(self) -> list[str]:
        return [p["name"] for p in _manifest(self.path)["pages"] if all(may_hold(p, f) for f in self.filters)]

    def partitions(self) -> list[Run]:
        pages = iter(self.pages())
        runs = [Run(run) for run in iter(lambda: list(itertools.islice(pages, self.run)), [])]
        return runs or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        kinds = to_arrow_schema(self.schema, prefers_large_types=False)
        convert = csv.ConvertOptions(
            column_types=kinds, include_columns=kinds.names, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]
        )
        parse = csv.ParseOptions(delimiter="\t", newlines_in_values=True)
        for page in partition.pages:
            with files.open_input_stream(f"{root}/{page}") as f:
                table = csv.read_csv(f, parse_options=parse, convert_options=convert)
            yield from table.cast(kinds).to_batches()


class PagedWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite
        self.rows = int(options.get("rows_per_page", ROWS_PER_PAGE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        pages, waiting, n = [], [], 0

        def put(table: pa.Table) -> None:
            name = f"page-{uuid.uuid4().hex}.tsv"
            with files.open_output_stream(f"{root}/{name}") as f:
                csv.write_csv(table, f, csv.WriteOptions(delimiter="\t", quoting_style="needed"))
            pages.append({"name": name, "rows": table.num_rows, "ranges": _ranges(table)})

        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                piece = batch.slice(at, self.rows)
                while piece.num_rows:
                    some = piece.slice(0, self.rows - n)
                    waiting.append(some)
                    n += some.num_rows
                    piece = piece.slice(some.num_rows)
                    if n == self.rows:
                        put(pa.Table.from_batches(waiting))
                        waiting, n = [], 0
        if waiting:
            put(pa.Table.from_batches(waiting))
        return Written(pages)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        before = []
        if not self.overwrite and files.get_file_info(f"{root}/{MANIFEST}").type != FileType.NotFound:
            before = _manifest(self.path)["pages"]
        pages = before + [page for message in messages if message for page in message.pages]
        beside = f"{root}/_{uuid.uuid4().hex}"
        with files.open_output_stream(beside) as f:
            f.write(json.dumps({"schema": self.schema.jsonValue(), "pages": pages}).encode())
        files.move(beside, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        for page in (page for message in messages if message for page in message.pages):
            files.delete_file(f"{root}/{page['name']}")


def _ranges(table: pa.Table) -> dict:
    """Smallest and largest value of the columns whose values JSON keeps as they are."""
    out = {}
    for field in table.schema:
        if pa.types.is_integer(field.type) or pa.types.is_string(field.type):
            found = compute.min_max(table[field.name]).as_py()
            out[field.name] = {"min": found["min"], "max": found["max"]}
    return out
