"""Registered queries for files, collections, result files and streaming
(A2-A13, B1-B12, F1-F10, incremental upsert), with their DuckDB oracles.

Queries that write (collections, sinks, result files) write to a fresh
folder under the session's checkpoint folder and return what they read back,
so the check compares the final state with SQL over the input tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import scalars as S
from nearfield.operators import report as RP
from nearfield.operators import stats as ST
from nearfield.operators.collection import Collection, with_batches
from nearfield.operators.ranking import ordered_positions
from nearfield.plans import catalog as C
from nearfield.session import scratch_path
from nearfield.sources import files as FS
from nearfield.streaming.upsert import run_upsert_stream

R = 6
BATCH = 500
DELETE_PREDICATE = "label >= 5"
def _run_ts():
    """Timestamp written into the result file names of the registered queries."""
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


PAYLOAD = T.StructType([T.StructField("image_path", T.StringType()), T.StructField("label", T.IntegerType())])


# -- A: union, ids, query files, labels, listing, templates, documents ------------------


def union_missing_columns(spark, sf_dir):
    a = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    b = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return FS.union_by_name([a, b])


def _label_files(spark, sf_dir):
    """One embedding folder per label, a corrupt file beside the rows of label 0, and a path that is not there."""
    e = C.table(spark, sf_dir, "embeddings")
    root = scratch_path(spark, "embedding-files")
    out = e.select("embedding", F.col("vec_id").cast("string").alias("image_path"), F.concat(F.lit("label_"), "label").alias("d"))
    out.repartition("d").write.partitionBy("d").parquet(root)
    labels = sorted(r["label"] for r in e.select("label").distinct().collect())
    bad = f"{root}/broken"
    C.table(spark, sf_dir, "region").limit(1).select(F.lit("no parquet").alias("value")).write.text(bad)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(bad).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(fs_path(bad)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), fs_path(f"{root}/d=label_{labels[0]}/broken.parquet"))
    return [f"{root}/d=label_{x}" for x in labels] + [f"{root}/d=absent"]


def embedding_files_read(spark, sf_dir):
    """A1: many files, of which one is corrupt and one is missing: the rows of the others."""
    rows = FS.read_embedding_files(spark, _label_files(spark, sf_dir))
    return rows.select(F.col("image_path").cast("long").alias("vec_id"), F.size("embedding").cast("long").alias("n"))


def embedding_files_whole(spark, sf_dir):
    """A1: a file that breaks midway gives no row and is reported, as are the corrupt one and the missing path."""
    paths = _label_files(spark, sf_dir)
    files = spark.read.format("binaryFile").load(paths[1])
    # The file without 64 bytes in its middle; the writer's line end puts back the last byte of the footer.
    cut = F.concat(F.expr("left(content, CAST(length DIV 2 AS INT))"), F.expr("substring(content, CAST(length DIV 2 AS INT) + 65)"))
    midway = scratch_path(spark, "midway")
    files.select(cut.alias("c")).select(F.expr("CAST(left(c, length(c) - 1) AS STRING)").alias("value")).write.option("lineSep", "1").text(midway)
    paths = [*paths, midway]
    report = FS.check_embedding_files(spark, paths)
    rows = FS.read_embedding_files(spark, paths, report=report)
    kept = rows.select(F.lit("row").alias("what"), F.col("image_path").alias("name"))
    broken = F.when(F.col("path").contains("broken.parquet"), "broken.parquet").when(F.col("path").contains("midway-"), "midway").otherwise(
        F.element_at(F.split("path", "/"), -1)
    )
    return kept.unionByName(report.where("NOT ok").select(F.substring_index("reason", ":", 1).alias("what"), broken.alias("name")))


def embedding_files_skipped(spark, sf_dir):
    """A1: the table of what the read left out."""
    paths = _label_files(spark, sf_dir)
    t = FS.skipped_files(spark, paths, FS.read_embedding_files(spark, paths))
    return t.select(F.element_at(F.split("path", "/"), -1).alias("name"), "reason")


def select_search_files(spark, sf_dir):
    """A7 over a path column: pages whose name contains a kind and ends in a suffix."""
    files = C.table(spark, sf_dir, "pages").select(F.concat("url", F.lit(".csv")).alias("path"))
    return FS.select_result_files(files, "7").select("path", "file_name")


def positional_ids(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return FS.positional_ids(d, ["lang", "doc_id"], "pos")


def query_csv_roundtrip(spark, sf_dir):
    """Class prototypes -> JSON-in-CSV query files -> read back (A4, A10)."""
    protos = C.class_queries(C.collection(spark, sf_dir)).withColumn(
        "image_path", F.concat(F.lit("./queries/class_"), F.col("query_id").cast("string"), F.lit(".JPG"))
    )
    path = scratch_path(spark, "queries-csv")
    FS.write_query_csv(protos, path)
    back = FS.read_query_csv(spark, path)
    return back.select("target", F.transform("embedding", lambda x: F.round(x, 4)).alias("vals"))


def label_wide_to_long(spark, sf_dir):
    return C.doc_labels_long(spark, sf_dir)


def suffix_filter(spark, sf_dir):
    p = C.table(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(S.has_suffix_ci("url", (".html",)))


def label_template(spark, sf_dir):
    files = C.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    t = FS.label_template(files, list(C.DOC_TARGETS))
    return t.where(S.non_empty("picture_name"))


def _with_paths(spark, sf_dir):
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    p = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("vec_id"), F.col("url").alias("image_path"))
    return e.join(p, "vec_id", "left")


def document_actions(spark, sf_dir):
    docs = FS.store_documents(_with_paths(spark, sf_dir), "Faces", id_col="vec_id")
    return docs.select(
        "_id",
        "_index",
        F.col("_source.image_path").alias("source_image_path"),
        F.size("_source.embedding").cast("long").alias("source_dims"),
    )


# -- B: collections ---------------------------------------------------------------------


def _batches(spark, sf_dir):
    """Batch 1: every embedding with an original path; batch 2: the embeddings
    that have a page, with the page URL as their new path (ids overlap where
    the data says so)."""
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    b1 = e.withColumn("image_path", F.concat(F.lit("orig/"), F.col("vec_id").cast("string")))
    p = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("vec_id"), F.col("url").alias("image_path"))
    b2 = e.join(p, "vec_id")
    return b1, b2


def _new_collection(spark, name):
    root = scratch_path(spark, "collections")
    return Collection(spark, root, name, dim=64, id_col="vec_id", payload=PAYLOAD).create()


def collection_append(spark, sf_dir):
    b1, b2 = _batches(spark, sf_dir)
    c = _new_collection(spark, "faces")
    c.append(b1)
    c.append(b2)
    return c.read().groupBy("vec_id").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def collection_upsert(spark, sf_dir):
    b1, b2 = _batches(spark, sf_dir)
    c = _new_collection(spark, "faces")
    c.append(b1)
    c.upsert(b2)
    return c.read().select("vec_id", "image_path", "label")


def collection_upsert_duplicates(spark, sf_dir):
    """One upsert input holds both versions of an id; the newest by its order column is stored."""
    b1, b2 = _batches(spark, sf_dir)
    c = _new_collection(spark, "faces")
    both = b1.withColumn("arrival", F.lit(1)).unionByName(b2.withColumn("arrival", F.lit(2)))
    c.upsert(both.repartition(8), order_col="arrival")
    return c.read().select("vec_id", "image_path", "label")


def collection_insert_ignore(spark, sf_dir):
    b1, b2 = _batches(spark, sf_dir)
    c = _new_collection(spark, "faces")
    c.insert_ignore(b2)
    c.insert_ignore(b1)
    return c.read().select("vec_id", "image_path", "label")


def collection_truncate(spark, sf_dir):
    b1, _ = _batches(spark, sf_dir)
    c = _new_collection(spark, "faces")
    c.append(b1)
    c.truncate()
    return c.read().select("vec_id", "image_path", "label")


def collection_delete_predicate(spark, sf_dir):
    b1, _ = _batches(spark, sf_dir)
    c = _new_collection(spark, "faces")
    c.append(b1)
    c.delete_where(DELETE_PREDICATE)
    return c.read().select("vec_id", "label")


def batch_numbering(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("doc_id")
    b = with_batches(ordered_positions(d, [], ["doc_id"], "pos"), "pos", BATCH)
    return b.groupBy("batch").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
    )


def batch_counts(spark, sf_dir):
    """Request batches per group: ceil(n / 500) and the last batch's size."""
    d = C.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    nb = S.batch_count("n_rows", BATCH)
    return d.select(
        "lang",
        F.col("n_rows").cast("long").alias("n_rows"),
        nb.alias("n_batches"),
        F.least(F.lit(BATCH), F.col("n_rows") - (nb - 1) * BATCH).cast("long").alias("last_batch_rows"),
    )


def load_run_label(spark, sf_dir):
    """The row count of the loaded collection in the run's file name."""
    n = C.table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    name = FS.results_file_name(FS.load_results_prefix(F.col("n_rows")), "SPARK", _run_ts())
    return n.select(name.alias("file_name"), "n_rows")


def parquet_sink_roundtrip(spark, sf_dir):
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    out = e.withColumn("model", F.lit("synthetic64")).withColumn(
        "source_dir", F.concat(F.lit("label_"), F.col("label").cast("string"))
    )
    root = scratch_path(spark, "embeddings-sink")
    FS.write_embeddings(out, root)
    back = spark.read.parquet(root)
    return back.groupBy("model", "source_dir").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum(F.size("embedding")).cast("long").alias("n_values"),
    )


def incremental_upsert_stream(spark, sf_dir):
    """Batch 1 and batch 2 land as files; a stream upserts them (B5 + B9)."""
    b1, b2 = _batches(spark, sf_dir)
    src = scratch_path(spark, "landing")
    # Files in arrival order: batch 1 (several files), then batch 2.
    b1.repartition(4, "vec_id").write.mode("append").parquet(f"{src}/a")
    b2.repartition(4, "vec_id").write.mode("append").parquet(f"{src}/b")
    c = _new_collection(spark, "faces")
    ckpt = scratch_path(spark, "stream-ckpt")
    run_upsert_stream(spark, f"{src}/a", b1.schema, c, ckpt + "/a", max_files_per_trigger=2)
    run_upsert_stream(spark, f"{src}/b", b2.schema, c, ckpt + "/b")
    return c.read().select("vec_id", "image_path", "label")


def stream_upsert_duplicates(spark, sf_dir):
    """Both versions of an id arrive in one micro-batch; the newest by arrival is stored."""
    b1, b2 = _batches(spark, sf_dir)
    src = scratch_path(spark, "landing")
    both = b1.withColumn("arrival", F.lit(1)).unionByName(b2.withColumn("arrival", F.lit(2)))
    both.repartition(4).write.parquet(src)
    c = _new_collection(spark, "faces")
    run_upsert_stream(spark, src, both.schema, c, scratch_path(spark, "stream-ckpt"), order_col="arrival")
    return c.read().select("vec_id", "image_path", "label")


# -- F: result files written from the request log, read back ----------------------------


def _write_results(spark, sf_dir) -> str:
    """Per store (event_type): detail rows (iteration, search_time, precision
    from ``props.k``) and summary statistics, as mixed result files (A11)."""
    ev = C.table(spark, sf_dir, "events")
    req = ev.select(
        "event_type", "ts", "event_id",
        F.col("value").alias("search_time"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("precision"),
        F.lit(True).alias("ok"),
    )
    it = ST.iteration_numbers(req, ["event_type"], ["ts", "event_id"], "ok")
    run = FS.results_file_name(
        FS.search_results_prefix(10, 100), F.upper("event_type"), _run_ts()
    )
    detail = it.withColumn("run_name", run)
    wide = ST.latency_summary(detail, "search_time", ["run_name"], prefix="search_time_")
    metrics = ["search_time_mean", "search_time_std", "search_time_p90", "search_time_p95", "search_time_p99"]
    summary = ST.summary_long(wide, ["run_name"], metrics)
    root = scratch_path(spark, "results")
    FS.write_results_csv(detail, summary, root, FS.SEARCH_RESULT_COLUMNS, "run_name")
    return root


def _results(spark, sf_dir):
    root = _write_results(spark, sf_dir)
    return FS.read_result_csvs(spark, root, FS.SEARCH_RESULT_COLUMNS)


def results_sink_mixed(spark, sf_dir):
    """A11 + A8: per run, the mixed file holds its detail rows and its summary
    rows; read back and split by ``try_cast(iteration as int)``."""
    raw = _results(spark, sf_dir)
    return raw.groupBy("database").agg(
        F.count_if(F.col("iteration_num").isNotNull()).cast("long").alias("n_detail"),
        F.count_if(F.col("iteration_num").isNull()).cast("long").alias("n_summary"),
        F.max("iteration_num").cast("long").alias("max_iteration"),
    )


def results_detail_scan(spark, sf_dir):
    d = FS.result_details(_results(spark, sf_dir))
    return d.select("database", "iteration", "search_time", "precision", "recall")


SUMMARY_METRICS = ["search_time_mean", "search_time_std", "search_time_p90", "search_time_p95", "search_time_p99"]


def results_summary_pivot(spark, sf_dir):
    s = FS.result_summary(_results(spark, sf_dir))
    p = s.groupBy("database").pivot("metric", SUMMARY_METRICS).agg(F.first("value"))
    return p.select("database", *[F.round(m, R).alias(m) for m in SUMMARY_METRICS])


def series_common_scale(spark, sf_dir):
    d = FS.result_details(_results(spark, sf_dir)).select("database", "iteration", "search_time")
    top = d.select(F.max("search_time")).scalar()
    return d.withColumn("scale", top)


def request_count_title(spark, sf_dir):
    d = FS.result_details(_results(spark, sf_dir))
    first = d.select(F.min("file_name")).scalar()
    return d.where(F.col("file_name") == first).groupBy("file_name").agg(
        F.max("iteration").cast("long").alias("n_requests")
    )


def quality_report_rollup(spark, sf_dir):
    d = FS.result_details(_results(spark, sf_dir))
    r = d.rollup("database").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg("search_time").alias("search_time"),
        F.avg("precision").alias("precision"),
    )
    return r.select("database", "n", F.round("search_time", R).alias("search_time"), F.round("precision", R).alias("precision"))


def _report_runs(spark, sf_dir):
    """The request log as runs: one per store, every request an iteration."""
    ev = C.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return ST.iteration_numbers(ev.withColumn("ok", F.lit(True)), ["event_type"], ["ts", "event_id"], "ok")


def _search_results(spark, sf_dir):
    it = _report_runs(spark, sf_dir)
    run = FS.results_file_name(FS.search_results_prefix(10, 100), F.upper("event_type"), _run_ts())
    detail = it.select(run.alias("run_name"), "iteration", F.col("value").alias("search_time"), "ts", (F.col("event_type") != "error").alias("success"))
    summary = RP.summarise_columns(detail, {"search_time": "search_time"}, ["run_name"])
    rate = ST.throughput(detail, ["run_name"], "ts", "success")
    rate = rate.withColumn("successful_requests", F.col("successful_requests").cast("double"))
    summary = summary.unionByName(rate.unpivot(["run_name"], ["rps", "successful_requests"], "metric", "value"))
    root = scratch_path(spark, "report-search")
    FS.write_results_csv(detail.select("run_name", "iteration", "search_time"), summary, root, FS.SEARCH_RESULT_COLUMNS, "run_name")
    return FS.read_result_csvs(spark, root, FS.SEARCH_RESULT_COLUMNS)


def report_search_tables(spark, sf_dir):
    """search files written, read back and reported, published metric names and labels."""
    t = RP.report_tables(_search_results(spark, sf_dir), RP.SEARCH_TABLES, FS.SEARCH_RESULT_COLUMNS)
    return t.select("table", "database", "store_label", "metric", F.round("value", R).alias("value"))


def _load_results(spark, sf_dir):
    it = _report_runs(spark, sf_dir)
    run = FS.results_file_name(FS.load_results_prefix(F.lit(100)), F.upper("event_type"), _run_ts())
    detail = it.select(
        run.alias("run_name"),
        "iteration",
        (F.col("value") / 8).alias("initialisation_time"),
        F.col("value").alias("insertion_time"),
        (F.col("value") / 64).alias("deletion_time"),
        F.col("k").alias("memory_usage_initialisation"),
        (F.col("k") * 2).alias("memory_usage_insertion"),
    )
    summary = RP.summarise_columns(detail, RP.LOAD_METRIC_PREFIX, ["run_name"])
    root = scratch_path(spark, "report-load")
    FS.write_results_csv(detail, summary, root, FS.LOAD_RESULT_COLUMNS, "run_name")
    return FS.read_result_csvs(spark, root, FS.LOAD_RESULT_COLUMNS)


def report_load_tables(spark, sf_dir):
    """load/delete files written, read back and reported, memory tables included."""
    t = RP.report_tables(_load_results(spark, sf_dir), RP.LOAD_TABLES, FS.LOAD_RESULT_COLUMNS)
    return t.select("table", "database", "store_label", "metric", F.round("value", R).alias("value"))


def report_load_series(spark, sf_dir):
    """F4 over a load file's column: memory during insertion, all stores on one scale."""
    s = RP.report_series(_load_results(spark, sf_dir), "memory_usage_insertion", FS.LOAD_RESULT_COLUMNS)
    return s.select("database", "iteration", "value", "scale")


def report_series_all(spark, sf_dir):
    """the six series of the report, from search and load files, each on a scale of its own over all stores."""
    found = RP.report_series_set(_search_results(spark, sf_dir), RP.SEARCH_SERIES, FS.SEARCH_RESULT_COLUMNS)
    load = RP.report_series_set(_load_results(spark, sf_dir), RP.LOAD_SERIES, FS.LOAD_RESULT_COLUMNS)
    return found.unionByName(load)


def report_value_labels(spark, sf_dir):
    """F8: bar labels (two decimals) of the requests served per store, an exact number."""
    it = _report_runs(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return it.select(
        S.capitalize("event_type").alias("store_label"), S.two_decimals(F.col("n").cast("double")).alias("label")
    )


QUERIES = {
    "union_missing_columns": union_missing_columns,
    "embedding_files_read": embedding_files_read,
    "embedding_files_skipped": embedding_files_skipped,
    "embedding_files_whole": embedding_files_whole,
    "select_search_files": select_search_files,
    "positional_ids": positional_ids,
    "query_csv_roundtrip": query_csv_roundtrip,
    "label_wide_to_long": label_wide_to_long,
    "suffix_filter": suffix_filter,
    "label_template": label_template,
    "document_actions": document_actions,
    "collection_append": collection_append,
    "collection_upsert": collection_upsert,
    "collection_upsert_duplicates": collection_upsert_duplicates,
    "collection_insert_ignore": collection_insert_ignore,
    "collection_truncate": collection_truncate,
    "collection_delete_predicate": collection_delete_predicate,
    "batch_numbering": batch_numbering,
    "batch_counts": batch_counts,
    "load_run_label": load_run_label,
    "parquet_sink_roundtrip": parquet_sink_roundtrip,
    "incremental_upsert_stream": incremental_upsert_stream,
    "stream_upsert_duplicates": stream_upsert_duplicates,
    "results_detail_scan": results_detail_scan,
    "results_sink_mixed": results_sink_mixed,
    "results_summary_pivot": results_summary_pivot,
    "series_common_scale": series_common_scale,
    "request_count_title": request_count_title,
    "quality_report_rollup": quality_report_rollup,
    "report_search_tables": report_search_tables,
    "report_load_tables": report_load_tables,
    "report_load_series": report_load_series,
    "report_series_all": report_series_all,
    "report_value_labels": report_value_labels,
}

# -- oracles -----------------------------------------------------------------------------

_UPSERT = """
SELECT e.vec_id, coalesce(p.url, 'orig/' || CAST(e.vec_id AS VARCHAR)) AS image_path, e.label
FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id"""

_DETAIL = """
WITH d AS (
  SELECT upper(event_type) AS database,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS iteration,
         value AS search_time,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS precision,
         CAST(NULL AS DOUBLE) AS recall,
         'vector_search_results_threads_10_iterations_100_database_' || upper(event_type)
           || '_2025-01-01_00-00-00.csv' AS file_name
  FROM events
)"""

ORACLES = {
    "union_missing_columns": """
SELECT vec_id AS id, label, CAST(NULL AS VARCHAR) AS url FROM embeddings
UNION ALL
SELECT page_id AS id, CAST(NULL AS INTEGER) AS label, url FROM pages""",
    "embedding_files_read": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings",
    "embedding_files_whole": """
SELECT 'row' AS what, CAST(vec_id AS VARCHAR) AS name FROM embeddings WHERE label IS NOT NULL
UNION ALL SELECT 'broken', 'broken.parquet' UNION ALL SELECT 'broken', 'midway' UNION ALL SELECT 'missing', 'd=absent'""",
    "embedding_files_skipped": "SELECT * FROM (VALUES ('d=absent', 'missing'), ('broken.parquet', 'no rows')) t(name, reason)",
    "select_search_files": """
SELECT url || '.csv' AS path, string_split(url || '.csv', '/')[-1] AS file_name FROM pages
WHERE contains(string_split(url || '.csv', '/')[-1], '7')""",
    "positional_ids": """
SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY lang, doc_id) - 1 AS BIGINT) AS pos FROM documents""",
    "query_csv_roundtrip": """
WITH u AS (
  SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings
)
SELECT 'class_' || CAST(label AS VARCHAR) || '.JPG' AS target, list(round(x, 4) ORDER BY pos) AS vals
FROM (SELECT label, pos, sum(x) AS x FROM u GROUP BY label, pos) GROUP BY label""",
    "label_wide_to_long": """
SELECT doc_id, 'quality' AS target, CAST(quality AS INTEGER) AS y_true FROM labels
UNION ALL
SELECT doc_id, 'toxic' AS target, CAST(toxic AS INTEGER) AS y_true FROM labels""",
    "suffix_filter": "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html'",
    "label_template": """
SELECT picture_name, 0 AS quality, 0 AS toxic FROM (
  SELECT DISTINCT string_split(url, '/')[-1] AS picture_name FROM pages
) WHERE picture_name <> ''""",
    "document_actions": """
SELECT CAST(e.vec_id AS VARCHAR) AS _id, 'faces' AS _index, p.url AS source_image_path,
       CAST(len(e.embedding) AS BIGINT) AS source_dims
FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id""",
    "collection_append": """
SELECT e.vec_id, CAST(CASE WHEN p.page_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_rows
FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id""",
    "collection_upsert": _UPSERT,
    "collection_upsert_duplicates": _UPSERT,
    "collection_insert_ignore": """
SELECT e.vec_id, coalesce(p.url, 'orig/' || CAST(e.vec_id AS VARCHAR)) AS image_path, e.label
FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id""",
    "collection_truncate": """
SELECT vec_id, CAST(NULL AS VARCHAR) AS image_path, label FROM embeddings WHERE false""",
    "collection_delete_predicate": "SELECT vec_id, label FROM embeddings WHERE NOT coalesce(label >= 5, false)",
    "batch_numbering": f"""
SELECT CAST(pos // {BATCH} AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_rows,
       min(doc_id) AS first_id, max(doc_id) AS last_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
GROUP BY 1""",
    "batch_counts": f"""
SELECT lang, CAST(n AS BIGINT) AS n_rows, CAST(ceil(n / {BATCH}) AS BIGINT) AS n_batches,
       CAST(least({BATCH}, n - (ceil(n / {BATCH}) - 1) * {BATCH}) AS BIGINT) AS last_batch_rows
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
    "load_run_label": """
SELECT 'vector_storing_and_deletion_results__size_' || CAST(count(*) AS VARCHAR)
       || '__database_SPARK_2025-01-01_00-00-00.csv' AS file_name,
       CAST(count(*) AS BIGINT) AS n_rows
FROM embeddings""",
    "parquet_sink_roundtrip": """
SELECT 'synthetic64' AS model, 'label_' || CAST(label AS VARCHAR) AS source_dir,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len(embedding)) AS BIGINT) AS n_values
FROM embeddings GROUP BY label""",
    "incremental_upsert_stream": _UPSERT,
    "stream_upsert_duplicates": _UPSERT,
    "results_sink_mixed": """
SELECT upper(event_type) AS database, CAST(count(*) AS BIGINT) AS n_detail,
       CAST(5 AS BIGINT) AS n_summary, CAST(count(*) AS BIGINT) AS max_iteration
FROM events GROUP BY event_type""",
    "results_detail_scan": _DETAIL + """
SELECT database, iteration, search_time, precision, recall FROM d""",
    "results_summary_pivot": f"""
SELECT upper(event_type) AS database,
       round(avg(value), {R}) AS search_time_mean, round(stddev_pop(value), {R}) AS search_time_std,
       round(quantile_cont(value, 0.90), {R}) AS search_time_p90,
       round(quantile_cont(value, 0.95), {R}) AS search_time_p95,
       round(quantile_cont(value, 0.99), {R}) AS search_time_p99
FROM events GROUP BY event_type""",
    "series_common_scale": _DETAIL + """
SELECT database, iteration, search_time, max(search_time) OVER () AS scale FROM d""",
    "request_count_title": _DETAIL + """
SELECT file_name, CAST(max(iteration) AS BIGINT) AS n_requests FROM d
WHERE file_name = (SELECT min(file_name) FROM d) GROUP BY file_name""",
    "quality_report_rollup": _DETAIL + f"""
SELECT database, CAST(count(*) AS BIGINT) AS n, round(avg(search_time), {R}) AS search_time,
       round(avg(precision), {R}) AS precision
FROM d GROUP BY ROLLUP (database)""",
}


def _stats_sql(column: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_mean": f"avg({column})",
        f"{prefix}_std": f"stddev_pop({column})",
        **{f"{prefix}_p{p}": f"quantile_cont({column}, 0.{p})" for p in (90, 95, 99)},
    }


def _tables_sql(tables: dict, exprs: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", upper(event_type) AS database, "
        f"upper(event_type[1:1]) || lower(event_type[2:]) AS store_label, '{m}' AS metric, "
        f"round(CAST({exprs[m]} AS DOUBLE), {R}) AS value FROM e GROUP BY event_type"
        for t, ms in tables.items()
        for m in ms
    )


_EVENTS_K = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)\n"
_ELAPSED = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0)"
_SUCCESS = "count(*) FILTER (WHERE event_type <> 'error')"

ORACLES["report_search_tables"] = _EVENTS_K + _tables_sql(
    RP.SEARCH_TABLES,
    {
        **_stats_sql("value", "search_time"),
        "rps": f"CASE WHEN {_ELAPSED} > 0 THEN {_SUCCESS} / {_ELAPSED} ELSE 0.0 END",
        "successful_requests": _SUCCESS,
    },
)
ORACLES["report_load_tables"] = _EVENTS_K + _tables_sql(
    RP.LOAD_TABLES,
    {
        **_stats_sql("value / 8", "initialisation"),
        **_stats_sql("value", "insertion"),
        **_stats_sql("value / 64", "deletion"),
        **_stats_sql("k", "memory_usage_init"),
        **_stats_sql("k * 2", "memory_usage_insert"),
    },
)
ORACLES["report_load_series"] = _EVENTS_K + """
SELECT upper(event_type) AS database,
       CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS iteration,
       k * 2 AS value, max(k * 2) OVER () AS scale
FROM e"""
_SERIES = {
    "search_time": "value",
    "initialisation_time": "value / 8",
    "insertion_time": "value",
    "deletion_time": "value / 64",
    "memory_usage_initialisation": "k",
    "memory_usage_insertion": "k * 2",
}
ORACLES["report_series_all"] = _EVENTS_K + " UNION ALL ".join(
    f"""
SELECT '{name}' AS series, upper(event_type) AS database,
       CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS iteration,
       {expr} AS value, max({expr}) OVER () AS scale
FROM e"""
    for name, expr in _SERIES.items()
)
ORACLES["report_value_labels"] = """
SELECT upper(event_type[1:1]) || lower(event_type[2:]) AS store_label, printf('%.2f', CAST(count(*) AS DOUBLE)) AS label
FROM events GROUP BY event_type"""
