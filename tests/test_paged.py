"""The paged data source: round trips, pruned pages, all or none."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThanOrEqual

from cohortloom.runtime import qualified
from cohortloom.sources import paged


@pytest.fixture
def place(spark, tmp_path):
    paged.register(spark)
    return qualified(spark, str(tmp_path / "pages"))


def write(df, place, mode="append", rows=3):
    df.write.format("pages").option("path", place).option("rows_per_page", rows).mode(mode).save()


def read(spark, place, **options):
    return spark.read.format("pages").options(path=place, **options).load()


def test_rows_come_back(spark, place):
    rows = [(1, "a", 1.5), (2, None, None), (3, "", 0.1), (None, "tab\there", 1e300), (5, "line\nbreak", -0.0), (6, 'a "quote"', 3.0), (7, "ä ", 1 / 3)]
    df = spark.createDataFrame(rows, "k long, t string, v double")
    write(df, place)
    write(df.limit(0), place)
    write(spark.createDataFrame([(8, "more", 2.0)], df.schema), place)
    back = read(spark, place)
    assert back.schema == df.schema
    assert sorted(map(tuple, back.collect()), key=str) == sorted([*rows, (8, "more", 2.0)], key=str)
    write(df.limit(2), place, "overwrite")
    assert read(spark, place).count() == 2


def test_pages_out_of_range_are_not_read(spark, place):
    write(spark.range(30).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("t")).coalesce(1), place, rows=10)
    reader = paged.PagedReader(read(spark, place).schema, {"path": place})
    sizes = []
    for filters in ([GreaterThan(("k",), 19)], [EqualTo(("k",), 5)], [In(("k",), (1, 25, None))], [GreaterThan(("k",), 3), LessThanOrEqual(("k",), 12)], [IsNull(("k",))], [GreaterThan(("k",), 99)]):
        assert list(reader.pushFilters(filters)) == filters
        sizes.append(len(reader.pages()))
    assert sizes == [1, 1, 2, 2, 3, 0]
    found = read(spark, place, pages_per_run=1).where("k > 19 AND k < 25")
    assert [r.k for r in found.orderBy("k").collect()] == [20, 21, 22, 23, 24]
    assert found.rdd.getNumPartitions() == 1 and read(spark, place, pages_per_run=1).rdd.getNumPartitions() == 3


def test_nulls_have_no_range():
    page = {"ranges": {"k": {"min": None, "max": None}}}
    assert not paged.may_hold(page, IsNotNull(("k",))) and paged.may_hold(page, IsNull(("k",))) and paged.may_hold(page, EqualTo(("other",), 1))


def test_a_failed_write_leaves_the_table_as_it_was(spark, place):
    write(spark.range(5).toDF("k"), place)
    broken = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        write(broken, place)
    assert sorted(r.k for r in read(spark, place).collect()) == [0, 1, 2, 3, 4]
