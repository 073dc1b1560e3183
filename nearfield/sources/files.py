"""Embedding files, query files, label files, result files.

Readers return DataFrames; writers take DataFrames.  No reader pulls file
contents through the driver: only path lists (from the file system listing)
are handled there.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.scalars import (
    IMAGE_SUFFIXES,
    TS_FILE_FORMAT,
    base_name,
    database_from_file_name,
    has_suffix_ci,
)
from nearfield.functions.vectors import json_to_vector, vector_to_json

log = logging.getLogger(__name__)

EMBEDDING_SCHEMA = T.StructType(
    [
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("image_path", T.StringType(), True),
    ]
)

# Column layout of the result files.  Search files of older
# runs have only the first five search columns (extra columns trail).
SEARCH_RESULT_COLUMNS = [
    "iteration", "search_time", "precision", "recall", "f1_score", "specificity", "far", "frr",
]
LOAD_RESULT_COLUMNS = [
    "iteration", "initialisation_time", "insertion_time", "deletion_time",
    "memory_usage_initialisation", "memory_usage_insertion",
]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def _listed_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The parquet files under existing paths, as Spark lists them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    return sorted(r["path"] for r in files.collect())


def _whole(spark: SparkSession, files: list[str], schema: T.StructType) -> str | None:
    """Read every column of every row of the files; the reason if one of them cannot be read."""
    try:
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(*files)
        rows.agg(F.bit_xor(F.xxhash64(*rows.columns))).collect()
        return None
    except Exception as failure:  # Spark raises different classes by where a file breaks
        lines = [x.strip() for x in str(failure).splitlines() if x.strip()]
        return next((x for x in lines if "Caused by" in x), lines[0] if lines else type(failure).__name__)[:300]


def check_embedding_files(spark: SparkSession, paths: list[str], schema: T.StructType = EMBEDDING_SCHEMA) -> DataFrame:
    """(path, ok, reason) of every file under ``paths``, and of paths that are missing (A1).

    Files are tested in groups by Spark jobs that read all of their columns:
    a group that can be read is whole, a group that cannot is halved.  With
    n files, b of them broken, that is one pass over the data and about
    b * log2(n) further jobs over ever smaller groups; files of any size are
    read in splits, and through whatever store Spark reads.
    """
    existing = [p for p in paths if _exists(spark, p)]
    out = [(p, False, "missing") for p in sorted(set(paths) - set(existing))]
    groups = [_listed_files(spark, existing)] if existing else []
    while groups:
        files = groups.pop()
        reason = _whole(spark, files, schema) if files else None
        if reason is None:
            out += [(f, True, None) for f in files]
        elif len(files) == 1:
            out.append((files[0], False, f"broken: {reason}"))
        else:
            groups += [files[: len(files) // 2], files[len(files) // 2 :]]
    for path, ok, reason in sorted(out):
        if not ok:
            log.warning("embedding file %s is skipped: %s", path, reason)
    return spark.createDataFrame(sorted(out), "path string, ok boolean, reason string")


def read_embedding_files(
    spark: SparkSession, paths: list[str], schema: T.StructType = EMBEDDING_SCHEMA, report: DataFrame | None = None
) -> DataFrame:
    """Read many parquet files, all rows of a file or none (A1, A2).

    Missing paths and files that break anywhere are left out as a whole (see
    ``check_embedding_files``, whose ``report`` can be passed in); if nothing
    readable is left, raise: an empty result would hide the failure.  Columns
    missing in a file come back NULL (the schema is applied by name).
    """
    if not any(_exists(spark, p) for p in paths):
        raise FileNotFoundError(f"none of the embedding files exist: {paths}")
    report = check_embedding_files(spark, paths, schema) if report is None else report
    whole = [r["path"] for r in report.where("ok").select("path").collect()]
    if not whole:
        raise ValueError("no readable embedding rows in the given files")
    df = spark.read.schema(schema).parquet(*whole).withColumn("source_file", F.input_file_name())
    if df.isEmpty():
        raise ValueError("no readable embedding rows in the given files")
    return df


def skipped_files(spark: SparkSession, paths: list[str], rows: DataFrame) -> DataFrame:
    """(path, reason) of what a ``read_embedding_files`` of ``paths`` left out (A1).

    ``missing``: the path does not exist.  ``no rows``: a listed parquet file
    that gave no row to ``rows`` (the result of the read): corrupt or empty.
    Only the listing and the distinct file names of the rows are used.
    """
    existing = [p for p in paths if _exists(spark, p)]
    missing = spark.createDataFrame([(p, "missing") for p in sorted(set(paths) - set(existing))], "path string, reason string")
    if not existing:
        return missing
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .load(existing).select("path")
    )
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = rows.select(same("source_file").alias("path")).distinct()
    silent = listed.select(same("path").alias("path")).join(seen, "path", "left_anti")
    return missing.unionByName(silent.withColumn("reason", F.lit("no rows")))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name, missing columns NULL (A2)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def positional_ids(df: DataFrame, order_cols: list, id_col: str = "id") -> DataFrame:
    """Dense 0..N-1 ids in the given order (A3): a window when the frame fits
    in one task, otherwise the range shuffle of ``ranking.positions``."""
    from nearfield.operators.ranking import ordered_positions

    return ordered_positions(df, [], order_cols, id_col)


def read_query_csv(spark: SparkSession, path: str) -> DataFrame:
    """Query-embedding CSV: ``embedding`` JSON text + ``image_path`` (A4).

    Every row is kept as a query (the source keeps only the last row);
    ``query_id`` is unique and stable for the same input files
    (``monotonically_increasing_id``), ``target`` is the base name of the
    query's image path."""
    df = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return df.select(
        F.monotonically_increasing_id().alias("query_id"),
        json_to_vector("embedding").alias("embedding"),
        F.col("image_path"),
        base_name("image_path").alias("target"),
    )


def write_query_csv(df: DataFrame, path: str, vec_col="embedding", path_col="image_path"):
    """One query embedding per item as JSON-in-CSV (A10)."""
    (
        df.select(vector_to_json(vec_col).alias("embedding"), F.col(path_col).alias("image_path"))
        .write.mode("overwrite")
        .option("header", "true")
        .csv(path)
    )


def list_files(spark: SparkSession, root: str, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """Recursive listing with a case-insensitive suffix filter.

    ``binaryFile`` lists on the executors; only ``path`` is projected, so the
    file contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    return files.where(has_suffix_ci("path", suffixes))


def read_files(spark: SparkSession, root: str, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """The listed files with their bytes: (path, source_dir, length, content) (A6 + H2).

    A task reads whole files, as many as fit in ``spark.sql.files.maxPartitionBytes``;
    ``source_dir`` is the folder that holds the file.  Spark's listing leaves
    files without bytes out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = F.element_at(F.split("path", "/"), -2)
    return files.where(has_suffix_ci("path", suffixes)).select("path", folder.alias("source_dir"), "length", "content")


def select_result_files(files: DataFrame, kind: str, path_col: str = "path") -> DataFrame:
    """Result files whose name contains ``kind`` and ends in ``.csv``, sorted."""
    name = base_name(path_col)
    return (
        files.where(name.contains(kind) & name.endswith(".csv"))
        .withColumn("file_name", name)
        .orderBy(path_col)
    )


def read_result_csvs(spark: SparkSession, paths, columns=SEARCH_RESULT_COLUMNS) -> DataFrame:
    """Mixed result files: detail rows + (Metric, Value) summary rows.

    All columns are read as text by position (PERMISSIVE fills short rows
    with NULL); ``try_cast`` then separates detail rows (integer iteration)
    from summary rows, and the store name comes from the file name.
    """
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .csv(paths)
        .withColumn("__path", F.col("_metadata.file_path"))
    )
    # A run written by Spark is a folder named like the result file.
    parent = F.element_at(F.split("__path", "/"), -2)
    raw = raw.withColumn(
        "file_name",
        F.when(parent.endswith(".csv"), F.element_at(F.split(parent, "="), -1)).otherwise(
            base_name("__path")
        ),
    ).drop("__path")
    return raw.withColumn("database", database_from_file_name("file_name")).withColumn(
        "iteration_num", F.expr("try_cast(iteration AS INT)")
    )


def result_details(raw: DataFrame, columns=SEARCH_RESULT_COLUMNS) -> DataFrame:
    """Detail rows with numeric coercion, bad values NULL (F1, F2)."""
    num = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in columns[1:]]
    return raw.where(F.col("iteration_num").isNotNull()).select(
        "file_name", "database", F.col("iteration_num").alias("iteration"), *num
    )


def result_summary(raw: DataFrame, columns=SEARCH_RESULT_COLUMNS) -> DataFrame:
    """Summary rows: (Metric, Value) sit in the first two columns."""
    return raw.where(F.col("iteration_num").isNull() & F.col("iteration").isNotNull()).select(
        "file_name",
        "database",
        F.col(columns[0]).alias("metric"),
        F.expr(f"try_cast({columns[1]} AS DOUBLE)").alias("value"),
    )


def write_results_csv(
    detail: DataFrame, summary: DataFrame, root: str, columns, run_col: str = "run_name"
):
    """Detail rows and summary rows (Metric, Value in the first two columns)
    of each run, as text in one CSV folder per run (A11).

    Both parts get the same all-string layout and are written together,
    partitioned by the run's file name (``run_col`` on both inputs), so every
    run folder reads back as one mixed result file and no run is funnelled
    through a single task.
    """
    width = len(columns)
    have = set(detail.columns)
    d = detail.select(
        run_col,
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns],
    )
    pad = [F.lit(None).cast("string").alias(c) for c in columns[2:width]]
    s = summary.select(
        run_col,
        F.col("metric").cast("string").alias(columns[0]),
        F.col("value").cast("string").alias(columns[1]),
        *pad,
    )
    (
        d.unionByName(s)
        .write.mode("overwrite")
        .option("header", "true")
        .partitionBy(run_col)
        .csv(root)
    )


# Result file name templates (the store name and a
# yyyy-MM-dd_HH-mm-ss timestamp follow "database_").
SEARCH_RESULTS_PREFIX = "vector_search_results_threads_{threads}_iterations_{iterations}_"
LOAD_RESULTS_PREFIX = "vector_storing_and_deletion_results__size_{size}__"


def _col_or_lit(x):
    return x if isinstance(x, F.Column) else F.lit(str(x))


def results_file_name(prefix, database, ts_col) -> F.Column:
    """``{prefix}database_{database}_{yyyy-MM-dd_HH-mm-ss}.csv`` (A11, G11);
    ``prefix`` and ``database`` may be columns."""
    return F.concat(
        _col_or_lit(prefix),
        F.lit("database_"),
        _col_or_lit(database),
        F.lit("_"),
        F.date_format(ts_col, TS_FILE_FORMAT),
        F.lit(".csv"),
    )


def search_results_prefix(threads: int, iterations: int) -> str:
    return SEARCH_RESULTS_PREFIX.format(threads=int(threads), iterations=int(iterations))


def load_results_prefix(size) -> F.Column:
    """Prefix of a load run; ``size`` (row count, E11) may be a column."""
    head, tail = LOAD_RESULTS_PREFIX.split("{size}")
    return F.concat(F.lit(head), _col_or_lit(size).cast("string"), F.lit(tail))


def write_embeddings(df: DataFrame, root: str, partition_cols=("model", "source_dir")):
    """Embedding sink: snappy parquet, partitioned by model and source folder."""
    (
        df.write.mode("append")
        .option("compression", "snappy")
        .partitionBy(*partition_cols)
        .parquet(root)
    )


def label_template(files: DataFrame, headers: list[str], path_col: str = "path") -> DataFrame:
    """One row per file name, every header column 0 (A12); empty headers raise."""
    if not headers:
        raise ValueError("label template needs at least one header")
    names = files.select(base_name(path_col).alias("picture_name")).distinct()
    return names.withColumns({h: F.lit(0) for h in headers})


def store_documents(df: DataFrame, index: str, id_col="id", vec_col="embedding", path_col="image_path"):
    """Per-row store documents ``_id`` / ``_index`` / ``_source``."""
    return df.select(
        F.col(id_col).cast("string").alias("_id"),
        F.lit(index.lower()).alias("_index"),
        F.struct(F.col(vec_col).alias("embedding"), F.col(path_col).alias("image_path")).alias(
            "_source"
        ),
    )
