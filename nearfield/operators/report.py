"""Report tables over result files (F4-F10): one row per store and metric.

A report is a set of named tables, each a list of summary metrics of one kind
of result file, and a set of series, each one detail column over the requests.
Both kinds of files (search, load/delete) go through the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import capitalize, two_decimals
from nearfield.operators.stats import latency_summary, summary_long
from nearfield.sources.files import result_details, result_summary

# The tables of the report and the summary metrics in each.
SEARCH_TABLES = {
    "search_mean_std": ("search_time_mean", "search_time_std"),
    "search_percentiles": ("search_time_p90", "search_time_p95", "search_time_p99"),
    "search_rps_successful_requests": ("rps", "successful_requests"),
}
LOAD_TABLES = {
    "initialisation_mean_std": ("initialisation_mean", "initialisation_std"),
    "insertion_mean_std": ("insertion_mean", "insertion_std"),
    "deletion_mean_std": ("deletion_mean", "deletion_std"),
    "initialisation_percentiles": ("initialisation_p90", "initialisation_p95", "initialisation_p99"),
    "insertion_percentiles": ("insertion_p90", "insertion_p95", "insertion_p99"),
    "deletion_percentiles": ("deletion_p90", "deletion_p95", "deletion_p99"),
    "memory_occupation_initialisation_mean_std": ("memory_usage_init_mean", "memory_usage_init_std"),
    "memory_occupation_insertion_mean_std": ("memory_usage_insert_mean", "memory_usage_insert_std"),
}
# Detail column -> prefix of its summary metrics in load files.
LOAD_METRIC_PREFIX = {
    "initialisation_time": "initialisation",
    "insertion_time": "insertion",
    "deletion_time": "deletion",
    "memory_usage_initialisation": "memory_usage_init",
    "memory_usage_insertion": "memory_usage_insert",
}
# The detail columns that are drawn over the requests.
SEARCH_SERIES = ("search_time",)
LOAD_SERIES = ("initialisation_time", "insertion_time", "deletion_time", "memory_usage_initialisation", "memory_usage_insertion")
QUALITY_METRICS = ("precision", "recall", "f1_score", "specificity", "far", "frr")


def summarise_columns(detail: DataFrame, prefixes: dict[str, str], run_cols: list[str]) -> DataFrame:
    """Summary rows (run..., metric, value) of several detail columns, named by their prefixes."""
    series = list(prefixes)
    values = detail.select(*run_cols, *[F.col(c).cast("double").alias(c) for c in series])
    long = values.unpivot(run_cols, series, "series", "value")
    name = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])[F.col("series")]
    wide = latency_summary(long.withColumn("series", name), "value", [*run_cols, "series"])
    out = summary_long(wide, [*run_cols, "series"], ["mean", "std", "p90", "p95", "p99"])
    return out.select(*run_cols, F.concat_ws("_", "series", "metric").alias("metric"), "value")


def report_tables(raw: DataFrame, tables: dict[str, tuple[str, ...]], columns) -> DataFrame:
    """(table, database, store_label, metric, value, label): the summary values of each
    report table, with the store's display name and the value as shown on a bar."""
    pairs = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(m).alias("metric")) for t, ms in tables.items() for m in ms])
    named = result_summary(raw, columns).select("database", F.col("metric").alias("__m"), "value", F.explode(pairs).alias("p"))
    return named.where(F.col("p.metric") == F.col("__m")).select(
        "p.table",
        "database",
        capitalize(F.lower("database")).alias("store_label"),
        "p.metric",
        "value",
        two_decimals("value").alias("label"),
    )


def report_series(raw: DataFrame, metric: str, columns) -> DataFrame:
    """(database, iteration, value, scale): one detail column of all stores on a common scale."""
    d = result_details(raw, columns).select("database", "iteration", F.col(metric).alias("value"))
    return d.withColumn("scale", d.select(F.max("value")).scalar())


def report_series_set(raw: DataFrame, metrics: tuple[str, ...], columns) -> DataFrame:
    """(series, database, iteration, value, scale): several detail columns in one pass, each on its own common scale.

    A value that is not a number stays a null row; a column of nulls has a null scale.
    """
    details = result_details(raw, columns)
    long = details.select("database", "iteration", *metrics).unpivot(["database", "iteration"], list(metrics), "series", "value")
    scales = details.agg(*[F.max(m).alias(m) for m in metrics]).unpivot([], list(metrics), "series", "scale")  # a row per series
    return long.join(F.broadcast(scales), "series").select("series", "database", "iteration", "value", "scale")


def quality_table(evaluated: DataFrame, keys=("database", "dataset")) -> DataFrame:
    """Mean of the quality metrics over the queries of each store and dataset."""
    return evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n_queries"), *[F.avg(m).alias(m) for m in QUALITY_METRICS]
    )
