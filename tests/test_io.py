"""Readers and writers on small staged files."""

import datetime
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortloom.operators import annotate, relational
from cohortloom.plans import analysis, subgroup
from cohortloom.runtime import clear_scratch, materialize, scratch_dir
from cohortloom.sources import readers, writers


def test_wide_matrix_file(spark, tmp_path):
    path = tmp_path / "matrix.tsv.gz"
    with gzip.open(path, "wt") as out:
        out.write("sample\tA-1\tA-2\tA-3\nx\t1.5\t\tNaN\ny\t0\t2\t3\n")
    assert [r.sample for r in readers.header_names(spark, str(path)).collect()] == ["A-1", "A-2", "A-3"]
    long = {(r.sample, r.feature): r.value for r in readers.read_matrix(spark, str(path)).collect()}
    assert long == {("A-1", "x"): 1.5, ("A-1", "y"): 0.0, ("A-2", "y"): 2.0, ("A-3", "y"): 3.0}
    some = readers.read_matrix(spark, str(path), ["A-3"]).collect()
    assert [tuple(r) for r in some] == [("A-3", "y", 3.0)]


def test_variant_comments_are_skipped(spark, tmp_path):
    (tmp_path / "v.maf").write_text("#version 1\nHugo_Symbol\tVariant_Classification\tTumor_Sample_Barcode\nG\tSilent\tT-1\n")
    assert [tuple(r) for r in readers.read_variants(spark, str(tmp_path / "v.maf")).collect()] == [("T-1", "G", "Silent")]


def test_a_matrix_wider_than_the_csv_limit(spark, tmp_path):
    wide = 21_000
    (tmp_path / "wide.tsv").write_text(
        "gene\t" + "\t".join(f"s{i}" for i in range(wide)) + "\n" + "a\t" + "\t".join(str(i) for i in range(wide)) + "\nb\t" + "\t".join(["", "NaN", "1.5", "x"] * (wide // 4)) + "\n"
    )
    path = str(tmp_path / "wide.tsv")
    assert readers.header_names(spark, path).count() == wide
    long = readers.read_matrix(spark, path)
    assert long.where("feature = 'a'").selectExpr("count(*)", "sum(value)").head() == (wide, wide * (wide - 1) / 2)
    assert long.where("feature = 'b'").selectExpr("count(*)", "min(value)", "max(value)").head() == (wide // 4, 1.5, 1.5)
    assert len(readers.read_tsv(spark, path).columns) == wide + 1


def test_gzip_rows_are_dealt_out(spark, tmp_path):
    import gzip

    folder = tmp_path / "variants"
    folder.mkdir()
    with gzip.open(folder / "part.maf.gz", "wt") as out:
        out.write("#v\nTumor_Sample_Barcode\tHugo_Symbol\tVariant_Classification\n" + "".join(f"T{i}\tG\tSilent\n" for i in range(200)))
    rows = readers.read_variants(spark, str(folder))
    assert rows.count() == 200 and rows.select(F.spark_partition_id()).distinct().count() > 1


def test_options_of_a_database_read():
    assert readers.jdbc_options("t", url="u") == {"dbtable": "t", "url": "u"}
    got = readers.jdbc_options("(SELECT 1) AS q", ("id", 0, 100, 8), url="u")
    assert got == {"dbtable": "(SELECT 1) AS q", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8", "url": "u"}


def test_interactions_keep_text_and_list(spark):
    doc = {"matchedTerms": [{"geneName": "G", "geneCategories": [{"name": "KINASE"}, {"name": "X"}], "interactions": [
        {"drugName": "D1", "score": 1.5, "interactionTypes": ["inhibitor", "binder"]}, {"drugName": "D2", "score": 2.0, "interactionTypes": []}]},
        {"geneName": "H", "geneCategories": [], "interactions": []}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    rows = {r.gene: r for r in readers.read_interactions(df, "value").collect()}
    assert rows["G"].interactions_text == "D1;1.5;inhibitor&binder&D2;2.0;"
    assert rows["G"].interactions_list == ["D1;1.5;inhibitor&binder", "D2;2.0;"] and rows["G"].categories == "KINASE,X"
    assert (rows["H"].n_interactions, rows["H"].interactions_text) == (0, "")


def test_structures_from_one_json_array(spark, tmp_path):
    records = [{"query": "G", "taxid": 9606, "pdb": ["1A", "2B"]}, {"query": "H", "taxid": 9606, "pdb": "3C"}, {"query": "I", "taxid": 9606}, {"query": "J", "taxid": 1, "pdb": "4D"}]
    (tmp_path / "r.json").write_text(json.dumps(records, indent=1))
    read = readers.read_json_records(spark, str(tmp_path / "r.json"), "query string, taxid int, pdb string")
    assert sorted(tuple(r) for r in readers.structure_records(read).collect()) == [("G", "1A;2B", 2), ("H", "3C", 1)]


def test_xml_documents_become_one_table(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}.xml").write_text(f'<entries xmlns="http://example.org/x"><entry><id>{i}</id></entry><entry><id>{i + 10}</id></entry></entries>')
    assert sorted(r.id for r in readers.read_xml_entries(spark, str(tmp_path), "id int").collect()) == [0, 1, 10, 11]


def test_pages_drop_repeated_headers_and_flatten(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.tsv").write_text(f"From\tEntry\nG{i}\tE{i}\n")
        (tmp_path / f"p{i}.json").write_text(json.dumps({"results": [{"id": f"r{i}"}], **({"failedIds": [f"x{i}"]} if i else {})}))
    paged = readers.read_paged_tsv(spark, str(tmp_path / "*.tsv"), "`From` string, Entry string")
    assert sorted(tuple(r) for r in paged.collect()) == [("G0", "E0"), ("G1", "E1")]
    results, failed = readers.read_paged_json(spark, str(tmp_path / "*.json"), "results array<struct<id:string>>, failedIds array<string>")
    assert sorted(r.id for r in results.collect()) == ["r0", "r1"] and [r.failed_id for r in failed.collect()] == ["x1"]


def test_unknown_payload_kind(spark):
    with pytest.raises(ValueError):
        readers.read_payload(spark, "/nowhere", "xlsx", "a int")


def test_manifest_states(spark, tmp_path):
    for name, text in (("good", "abc"), ("short", "ab"), ("other", "xyz")):
        (tmp_path / name).write_text(text)
    digest = hashlib.md5(b"abc").hexdigest()
    manifest = spark.createDataFrame([(n, digest, 3) for n in ("good", "short", "other", "gone")], "filename string, md5 string, size bigint")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    states = {r.filename: r.state for r in readers.verify_manifest(files, manifest).collect()}
    assert states == {"good": "validated", "short": "wrong size", "other": "wrong content", "gone": "missing"}


def test_digests_of_files_that_no_task_holds_whole(spark, tmp_path, monkeypatch):
    """Files over the limit of a content column, packed ones as they lie there, and those in a store that only Spark opens."""
    texts = {"one two": b"abcdefghij" * 3, "packed.gz": gzip.compress(b"some text")}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    expected = {(name, hashlib.md5(text).hexdigest(), len(text)) for name, text in texts.items()}
    monkeypatch.setattr(readers, "DIGEST_BYTES", 7)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 2)
    try:
        files = spark.read.format("binaryFile").load(str(tmp_path))
        manifest = readers.file_digests(files)
        assert {tuple(row) for row in manifest.collect()} == expected
        assert {r.state for r in readers.verify_manifest(files, manifest).collect()} == {"validated"}
    finally:
        spark.conf.unset(limit)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    away = spark.read.format("binaryFile").load("viewfs://shelf/in")
    assert {tuple(row) for row in readers.file_digests(away).collect()} == expected
    assert readers.file_digests(files.where("length > 1000")).count() == 0


def test_snapshot_is_built_once_and_again_if_unfinished(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "snap")
    assert writers.snapshot(spark, path, build).count() == 3 and writers.snapshot(spark, path, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "snap" / "_SUCCESS").unlink()
    assert writers.snapshot(spark, path, build).count() == 3 and len(calls) == 2


def test_sorted_result_is_in_order_over_files(spark, tmp_path):
    df = spark.createDataFrame([(f"g{i * 37 % 100:02d}",) for i in range(100)], "gene string")
    writers.write_sorted(df, str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*.csv")) for line in f.read_text().splitlines()[1:]]
    assert lines == sorted(lines) and len(lines) == 100


def test_score_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "scores")
    for run in ("a", "b"):
        writers.append_scores(spark.createDataFrame([(run, 0.5)], "run_id string, silhouette double"), path)
    assert {r.run_id for r in spark.read.parquet(path).collect()} == {"a", "b"}


def test_a_run_that_is_tried_again_has_one_row(spark, tmp_path, monkeypatch):
    """An attempt that fails between its rows and its marker leaves the table as it was."""
    path = str(tmp_path / "scores")
    schema = StructType.fromDDL("run_id string, silhouette double")
    rows = lambda *values: spark.createDataFrame(list(values), schema)
    assert writers.read_scores(spark, path, schema).collect() == []
    writers.append_scores(rows(("a", 0.1), ("b", 0.2)), path)
    with monkeypatch.context() as broken:
        broken.setattr(writers, "_put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            writers.append_scores(rows(("a", 0.3), ("c", 0.4)), path)
    read = lambda: sorted(tuple(r) for r in writers.read_scores(spark, path, schema).collect())
    assert read() == [("a", 0.1), ("b", 0.2)]
    writers.append_scores(rows(("a", 0.3), ("c", 0.4)), path)
    assert read() == [("a", 0.3), ("b", 0.2), ("c", 0.4)]


def test_prefixed_database_table(spark):
    spark.createDataFrame([("G", "t", 1)], "g string, TYPE string, SUPPORT int").createOrReplaceTempView("COAD")
    assert readers.read_db_table(spark, "COAD").columns == ["gene", "COAD_TYPE", "COAD_SUPPORT"]


def test_two_text_mining_tables_keep_their_names(spark):
    a = spark.createDataFrame([("G", 1)], "g string, COUNT int")
    b = spark.createDataFrame([("H", 2)], "g string, COUNT int")
    joined = analysis.text_mining({"A": a, "B": b})
    assert joined.columns == ["gene", "A_COUNT", "B_COUNT"] and joined.count() == 2


def test_structure_ids_count_distinct(spark):
    rows = [("G", "E1", "reviewed", "1A;2B"), ("G", "E2", "reviewed", "2B"), ("G", "E3", "unreviewed", "9Z"), ("H", "E4", "reviewed", None)]
    got = annotate.structure_ids(spark.createDataFrame(rows, "gene string, entry string, reviewed string, pdb string"))
    assert {r.gene: (r.entries, r.pdb_ids, r.pdb_count) for r in got.collect()} == {"G": ("E1;E2", "1A;2B", 2), "H": ("E4", "", 0)}


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, a int")
    wide = relational.outer_by_union({"one": a, "two": b}, "k", "a")
    assert {tuple(r) for r in wide.collect()} == {("x", 1, None), ("y", 2, 3), ("z", None, 4)}
    assert relational.join_without_missing([a, None, b.withColumnRenamed("a", "b")], "k").collect()[0].k == "y"
    lists = {r.k: r["values"] for r in relational.multimap([a, b, a], "k", "a").collect()}
    assert lists == {"x": [1, 1], "y": [2, 3, 2], "z": [4]}


def test_pending_runs(spark):
    groups = spark.createDataFrame([("C_GROUP_20220127-120900.txt",), ("C_GROUP_20220128-1.txt",), ("readme",)], "file string")
    done = spark.createDataFrame([("C_EDGER_DEG_20220127-120900.txt",)], "file string")
    assert [r.run_id for r in relational.pending_runs(groups, done).collect()] == ["20220128-1"]


def test_scratch_follows_the_session_setting(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        assert scratch_dir(spark).startswith("/tmp")
    else:
        assert scratch_dir(spark) == before.rstrip("/") + "/cohortloom"


def test_failed_cycle_is_a_row(spark, monkeypatch):
    vectors = spark.createDataFrame([(f"s{i}", [float(i), 1.0]) for i in range(8)], "sample string, vector array<double>")
    monkeypatch.setattr(subgroup, "sample_vectors", lambda *a: vectors)
    survival = spark.createDataFrame([(f"s{i}", 0, 5) for i in range(8)], "sample string, os int, os_time int")
    matrix = spark.createDataFrame([("Rna", "s1", "f", 1.0)], "modality string, sample string, feature string, value double")
    small = {n: subgroup.replace(v, neurons=8, bottleneck=2, epochs=1) for n, v in subgroup.embed.VARIANTS.items()}
    scores, grouping = subgroup.run_cycle(matrix, survival, survival, "r1", subgroup.CycleSettings(networks=small))
    row = scores.head()
    assert row.run_id == "r1" and row.error and row.silhouette is None and grouping.groups is None


def test_scratch_is_cleared_on_request(spark):
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3 and clear_scratch(spark)
    assert not writers.path_exists(spark, kept.inputFiles()[0])


def test_cycles_go_on_after_a_failure(spark, tmp_path, monkeypatch):
    def cycle(matrix, survival, burden, run_id, settings):
        if run_id == "bad":
            raise RuntimeError("no luck")
        groups = spark.createDataFrame([("s1", 0), ("s2", 1)], "sample string, group int")
        weights = subgroup.embed._start(subgroup.embed.Network(neurons=4, bottleneck=1), 2)
        trained = subgroup.embed.Trained(subgroup.embed.Network(neurons=4, bottleneck=1), 2, weights)
        row = spark.createDataFrame([(run_id, *[0.5] * 9, None)], subgroup.SCORE_SCHEMA)
        return row, subgroup.Grouping("ok", "encoder_vanilla", 0.5, groups, trained)

    monkeypatch.setattr(subgroup, "run_cycle", cycle)
    frame = spark.range(1)
    table = subgroup.run_cycles(frame, frame, frame, ["a", "bad", "c"], str(tmp_path), "X")
    assert {r.run_id: r.error for r in table.collect()} == {"a": None, "bad": "no luck", "c": None}
    groups = readers.read_tsv(spark, str(tmp_path / "group/X/X_GROUP_a"), "sample string, group int")
    assert sorted(tuple(r) for r in groups.collect()) == [("s1", 0), ("s2", 1)]


def test_final_table_is_written_under_its_name(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "gene string, v int")
    path = analysis.write_analysis(df, str(tmp_path), "X", 331, datetime.datetime(2022, 1, 27, 12, 9, 0))
    assert path.endswith("/RESULT/X/X-RandomSeed-331-20220127-120900.csv")
    assert [r.gene for r in spark.read.csv(path, header=True).collect()] == ["a", "b"]
