"""Queries that write a given table in some file form, read it back through the readers, and return what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import matrix
from cohortloom.operators.relational import pending_runs
from cohortloom.plans.registry import query
from cohortloom.plans.views import orders_view, table, view, with_views
from cohortloom.runtime import qualified, scratch_path, union_all
from cohortloom.sources import paged, readers, writers

_SUPPLIER_SCHEMA = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _staged_tsv(spark, df, name, compression=None):
    path = scratch_path(spark, name)
    writers.write_tsv(df, path, compression)
    return path


@query("scan_tsv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_tsv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    path = _staged_tsv(spark, orders, "orders")
    return readers.read_tsv(
        spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    )


@query("scan_tsv_projected", "SELECT s_suppkey, s_acctbal FROM supplier")
def scan_tsv_projected(spark, sf_dir):
    path = _staged_tsv(spark, table(spark, sf_dir, "supplier"), "supplier")
    return readers.read_tsv(spark, path, _SUPPLIER_SCHEMA, ["s_suppkey", "s_acctbal"])


@query("scan_tsv_gz", _SUPPLIER)
def scan_tsv_gz(spark, sf_dir):
    path = _staged_tsv(spark, table(spark, sf_dir, "supplier"), "supplier", "gzip")
    return readers.read_tsv(spark, path, _SUPPLIER_SCHEMA)


def _wide_counts(spark, sf_dir):
    """Gene-by-sample counts of the view, as the wide table the matrix files hold."""
    return matrix.to_wide(view(spark, sf_dir, "fx_counts"), "gene", "sample", "cnt")


@query("scan_header_probe", with_views("fx_counts", "SELECT DISTINCT CAST(sample AS VARCHAR) AS sample FROM fx_counts"))
def scan_header_probe(spark, sf_dir):
    path = _staged_tsv(spark, _wide_counts(spark, sf_dir), "counts")
    return readers.header_names(spark, path)


@query(
    "scan_chunked_union",
    "SELECT l_orderkey, l_linenumber, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem",
)
def scan_chunked_union(spark, sf_dir):
    """Row batches by ship date, each written by itself, read as one table."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    base = scratch_path(spark, "batches")
    rows.withColumn("year", F.year("l_shipdate")).write.partitionBy("year").parquet(base)
    read = spark.read.parquet(base)
    return read.select("l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


@query(
    "matrix_wide_to_long",
    with_views("fx_counts", "SELECT CAST(sample AS VARCHAR) AS sample, gene AS feature, CAST(cnt AS DOUBLE) AS value FROM fx_counts"),
)
def matrix_wide_to_long(spark, sf_dir):
    path = _staged_tsv(spark, _wide_counts(spark, sf_dir), "counts")
    return readers.read_matrix(spark, path)


@query("scan_variant_long", with_views("fx_variants", "SELECT * FROM fx_variants"))
def scan_variant_long(spark, sf_dir):
    named = view(spark, sf_dir, "fx_variants").toDF("Tumor_Sample_Barcode", "Hugo_Symbol", "Variant_Classification")
    return readers.read_variants(spark, _staged_tsv(spark, named, "variants", "gzip"))


@query("scan_snapshot", with_views("fx_matrix", "SELECT sample, feature, value FROM fx_matrix"))
def scan_snapshot(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    writers.snapshot(spark, path, lambda: view(spark, sf_dir, "fx_matrix"))
    return spark.read.parquet(path)


@query(
    "scan_db_table",
    "SELECT s_name AS gene, s_suppkey AS staged_supplier_s_suppkey, s_acctbal AS staged_supplier_s_acctbal FROM supplier",
)
def scan_db_table(spark, sf_dir):
    table(spark, sf_dir, "supplier").select("s_name", "s_suppkey", "s_acctbal").createOrReplaceTempView("staged_supplier")
    return readers.read_db_table(spark, "staged_supplier")


@query(
    "scan_db_query",
    "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority",
)
def scan_db_query(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("staged_orders")
    return readers.read_db_query(
        spark,
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM staged_orders GROUP BY o_orderpriority",
    )


@query(
    "scan_nested_json",
    with_views(
        "fx_interactions",
        """+items AS (SELECT gene, partner, score, list(DISTINCT interaction_type ORDER BY interaction_type) AS types,
                list(DISTINCT category ORDER BY category) AS categories FROM fx_interactions GROUP BY 1, 2, 3)
        SELECT gene || ':' || partner AS gene, array_to_string(list_sort(list_distinct(flatten(list(categories)))), ',') AS categories,
               string_agg(partner || ';' || CAST(score AS VARCHAR) || '.0;' || array_to_string(types, '&'), '&' ORDER BY score) AS interactions_text,
               COUNT(*)::INTEGER AS n_interactions
        FROM items GROUP BY gene, partner""",
    ),
)
def scan_nested_json(spark, sf_dir):
    """One document per (gene, partner), written as JSON lines and parsed back."""
    rows = view(spark, sf_dir, "fx_interactions")
    types = rows.groupBy("gene", "partner", "score").agg(
        F.sort_array(F.collect_set("interaction_type")).alias("types"), F.collect_set("category").alias("cats")
    )
    terms = types.groupBy("gene", "partner").agg(
        F.sort_array(F.collect_list(F.struct("score", "types"))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cats")))).alias("cats"),
    )
    term = F.struct(
        F.concat_ws(":", "gene", "partner").alias("geneName"),
        F.transform("cats", lambda c: F.struct(c.alias("name"))).alias("geneCategories"),
        F.transform(
            "found",
            lambda i: F.struct(
                F.col("partner").alias("drugName"),
                i["score"].cast("double").alias("score"),
                i["types"].alias("interactionTypes"),
            ),
        ).alias("interactions"),
    )
    path = scratch_path(spark, "interactions")
    terms.select(F.to_json(F.struct(F.array(term).alias("matchedTerms"))).alias("value")).write.text(path)
    return readers.read_interactions(spark.read.text(path), "value").drop("interactions_list")


@query(
    "scan_json_records",
    "SELECT p_name AS gene, CASE WHEN p_size % 2 = 0 THEN p_brand || ';' || p_type ELSE p_brand END AS pdb_ids, "
    "CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS pdb_count FROM part WHERE p_size % 3 <> 0",
)
def scan_json_records(spark, sf_dir):
    """Structure records whose ``pdb`` is one text or a list, in batches of one JSON array per line."""
    part = table(spark, sf_dir, "part")
    one, two = F.to_json(F.array("p_brand", "p_type")), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))
    record = F.concat(
        F.lit('{"query":"'), F.col("p_name"), F.lit('","taxid":'),
        F.when(F.col("p_size") % 3 == 0, "10090").otherwise("9606"),
        F.lit(',"pdb":'), F.when(F.col("p_size") % 2 == 0, one).otherwise(two), F.lit("}"),
    )
    batches = part.groupBy(F.floor(F.col("p_partkey") / 200)).agg(F.collect_list(record).alias("records"))
    path = scratch_path(spark, "records")
    batches.select(F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")).alias("value")).write.text(path)
    records = readers.read_json_records(spark, path, "query string, taxid int, pdb string", whole_file=False)
    return readers.structure_records(records)


@query(
    "scan_text_header_in_band",
    with_views("fx_oncogenes", "SELECT gene, is_oncogene AS src_is_oncogene, is_tsg AS src_is_tsg, background AS src_background FROM fx_oncogenes"),
)
def scan_text_header_in_band(spark, sf_dir):
    path = _staged_tsv(spark, view(spark, sf_dir, "fx_oncogenes"), "oncogenes")
    read = readers.read_tsv(spark, path)
    return read.toDF("gene", *[f"src_{c}" for c in read.columns[1:]])


@query("scan_xml_merge", "SELECT p_partkey AS accession, p_name AS name, p_size AS length FROM part")
def scan_xml_merge(spark, sf_dir):
    path = scratch_path(spark, "entries")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("accession"), F.col("p_name").alias("name"), F.col("p_size").alias("length")
    )
    part.repartitionByRange(4, "accession").write.format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)
    return readers.read_xml_entries(spark, path, "accession bigint, name string, length int")


@query(
    "scan_paged_batches",
    "SELECT 'tsv' AS kind, CAST(s_suppkey AS VARCHAR) AS id FROM supplier UNION ALL "
    "SELECT 'result' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size % 7 <> 0 UNION ALL "
    "SELECT 'failed' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size % 7 = 0",
)
def scan_paged_batches(spark, sf_dir):
    """Pages of a TSV result, each with its header, and pages of a JSON result with results and failed ids."""
    tsv_path = scratch_path(spark, "pages-tsv")
    writers.write_tsv(table(spark, sf_dir, "supplier").repartitionByRange(4, "s_suppkey"), tsv_path)
    tsv = readers.read_paged_tsv(spark, tsv_path, _SUPPLIER_SCHEMA)

    failed = F.col("p_size") % 7 == 0
    key = F.col("p_partkey").cast("string")
    pages = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 200)).agg(
        F.collect_list(F.when(~failed, F.struct(key.alias("id")))).alias("results"),
        F.collect_list(F.when(failed, key)).alias("failedIds"),
    )
    json_path = scratch_path(spark, "pages-json")
    pages.select("results", "failedIds").write.json(json_path)
    results, failures = readers.read_paged_json(
        spark, json_path, "results array<struct<id:string>>, failedIds array<string>", whole_file=False
    )
    return union_all(
        [
            tsv.select(F.lit("tsv").alias("kind"), F.col("s_suppkey").cast("string").alias("id")),
            results.select(F.lit("result").alias("kind"), "id"),
            failures.select(F.lit("failed").alias("kind"), F.col("failed_id").alias("id")),
        ]
    )


@query(
    "scan_paged_source",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey > 4 AND s_suppkey <= 60",
)
def scan_paged_source(spark, sf_dir):
    """Pages written and read through the data source of their own; a filter on the key leaves out the pages beyond it."""
    paged.register(spark)
    path = qualified(spark, scratch_path(spark, "pages"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    rows.repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey").write.format("pages").option("path", path).option("rows_per_page", 10).mode("append").save()
    return spark.read.format("pages").option("path", path).option("pages_per_run", 2).load().where("s_suppkey > 4 AND s_suppkey <= 60")


@query(
    "ingest_payload_files",
    "SELECT kind, COUNT(*) AS n, CAST(SUM(s_suppkey) AS BIGINT) AS key_sum FROM supplier, "
    "(VALUES ('json'), ('json.gz'), ('tsv'), ('tsv.gz'), ('xml'), ('xml.gz'), ('text'), ('text.gz')) AS k(kind) GROUP BY kind",
)
def ingest_payload_files(spark, sf_dir):
    """The same table as plain and gzip JSON, TSV, XML and text, read by kind."""
    supplier = table(spark, sf_dir, "supplier")
    read = []
    for gzip in (None, "gzip"):
        for kind in ("json", "tsv", "xml", "text"):
            path = scratch_path(spark, f"payload-{kind}")
            if kind == "json":
                supplier.write.json(path, compression=gzip or "none")
            elif kind == "tsv":
                writers.write_tsv(supplier, path, gzip)
            elif kind == "xml":
                writer = supplier.write.format("xml").option("rootTag", "entries").option("rowTag", "entry")
                (writer.option("compression", gzip) if gzip else writer).save(path)
            else:
                supplier.select(F.col("s_suppkey").cast("string")).write.text(path, compression=gzip or "none")
            rows = readers.read_payload(spark, path, kind, _SUPPLIER_SCHEMA, whole_file=False)
            key = F.col("value").cast("bigint") if kind == "text" else F.col("s_suppkey")
            read.append(rows.select(F.lit(kind + (".gz" if gzip else "")).alias("kind"), key.alias("k")))
    return union_all(read).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"))


@query(
    "scan_many_sample_files",
    with_views("fx_counts", "SELECT sample, gene, cnt FROM fx_counts"),
)
def scan_many_sample_files(spark, sf_dir):
    counts = view(spark, sf_dir, "fx_counts").select("sample", "gene", "cnt")
    base = scratch_path(spark, "sample-files")
    named = counts.withColumn("id", F.md5(F.col("sample").cast("string")))
    named.select("gene", "cnt", "id").write.partitionBy("id").csv(base, sep="\t", header=True)
    manifest = counts.select("sample").distinct().withColumn("id", F.md5(F.col("sample").cast("string")))
    return readers.read_sample_files(spark, f"{base}/*", manifest, "gene string, cnt bigint").select("sample", "gene", "cnt")


@query("scan_key_map", "SELECT p_name AS symbol, MIN('E' || p_partkey) AS ensembl FROM part GROUP BY p_name")
def scan_key_map(spark, sf_dir):
    links = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("symbol"), F.concat(F.lit("E"), F.col("p_partkey")).alias("ensembl")
    )
    return readers.key_map(links, "symbol", "ensembl")


@query("sink_tsv", with_views("fx_deg", "SELECT run_id, gene, log2fc, pvalue FROM fx_deg"))
def sink_tsv(spark, sf_dir):
    path = _staged_tsv(spark, view(spark, sf_dir, "fx_deg"), "deg")
    return readers.read_tsv(spark, path, "run_id bigint, gene string, log2fc double, pvalue double")


@query("sink_append_scores", with_views("fx_scores", "SELECT * FROM fx_scores"))
def sink_append_scores(spark, sf_dir):
    """Two appends of disjoint score rows make the whole history; one that is tried again replaces its rows."""
    scores = orders_view(spark, sf_dir, "fx_scores")
    path = scratch_path(spark, "scores")
    writers.append_scores(scores.where(F.col("silhouette") >= 0.05), path)
    writers.append_scores(scores.where(F.col("silhouette") < 0.05), path)
    writers.append_scores(scores.where(F.col("silhouette") >= 0.05), path)
    return writers.read_scores(spark, path, scores.schema)


@query("sink_sorted_result", with_views("fx_deg", "SELECT gene, run_id, log2fc FROM fx_deg ORDER BY gene"))
def sink_sorted_result(spark, sf_dir):
    path = scratch_path(spark, "sorted")
    writers.write_sorted(view(spark, sf_dir, "fx_deg").select("gene", "run_id", "log2fc"), path)
    return spark.read.csv(path, header=True, schema="gene string, run_id bigint, log2fc double")


@query("sink_snapshot_if_absent", with_views("fx_matrix6", "SELECT modality, COUNT(*) AS n, SUM(value) AS total FROM fx_matrix6 GROUP BY 1"))
def sink_snapshot_if_absent(spark, sf_dir):
    """The second call must read what the first one wrote: its builder would fail."""
    path = scratch_path(spark, "snapshot6")

    def missing():
        raise AssertionError("the snapshot was there already")

    writers.snapshot(spark, path, lambda: view(spark, sf_dir, "fx_matrix6"))
    kept = writers.snapshot(spark, path, missing)
    return kept.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("sink_bundle", with_views("fx_matrix6", "SELECT sample, feature, value, modality FROM fx_matrix6"))
def sink_bundle(spark, sf_dir):
    path = scratch_path(spark, "bundle")
    writers.write_bundle(view(spark, sf_dir, "fx_matrix6"), path)
    return spark.read.parquet(path)


@query("sink_first_column", with_views("fx_oncogenes", "SELECT gene FROM fx_oncogenes"))
def sink_first_column(spark, sf_dir):
    path = scratch_path(spark, "genes")
    writers.write_first_column(view(spark, sf_dir, "fx_oncogenes"), path)
    return readers.read_tsv(spark, path)


@query(
    "pending_work",
    "WITH files AS (SELECT 'COAD_GROUP_' || (20220100 + o_custkey) || '-' || (100000 + o_orderkey) || '.txt' AS file, o_orderstatus FROM orders), "
    "runs AS (SELECT regexp_extract(file, '[0-9]+-[0-9]+') AS run_id, o_orderstatus FROM files) "
    "SELECT run_id FROM runs WHERE o_orderstatus <> 'F'",
)
def pending_work(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stamp = F.concat_ws("-", F.col("o_custkey") + 20220100, F.col("o_orderkey") + 100000)
    groups = orders.select(F.concat(F.lit("COAD_GROUP_"), stamp, F.lit(".txt")).alias("file"))
    done = orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("COAD_EDGER_DEG_"), stamp, F.lit(".txt")).alias("file"))
    return pending_runs(groups, done)


@query("manifest_verify")
def manifest_verify(spark, sf_dir):
    """The given tables' own files against a manifest made from them; every file must come out validated."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/*.parquet")
    manifest = readers.file_digests(files)
    return readers.verify_manifest(files, manifest).select("filename", "md5", "size", "state")
