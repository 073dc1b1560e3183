"""A small timer of collection loads, for ``bench.py``: per iteration, drop, then
timed create, insert and delete (drop) of a collection, with the driver JVM's
heap change as the memory figure.  No registered query uses it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import stats as ST
from nearfield.operators.collection import Collection

PCTS = (90, 95, 99)


def _summary(detail: DataFrame, value_cols: list[str], id_cols: list[str]) -> DataFrame:
    """mean / population std / p90 / p95 / p99 of each value column, long form."""
    long = detail.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        id_cols, value_cols, "series", "value"
    )
    wide = ST.latency_summary(long, "value", [*id_cols, "series"])
    stats = ["mean", "std", *[f"p{p}" for p in PCTS]]
    out = ST.summary_long(wide, [*id_cols, "series"], stats)
    return out.select(
        *id_cols, F.concat_ws("_", "series", "metric").alias("metric"), "value"
    )


def load_benchmark(
    spark: SparkSession,
    data: DataFrame,
    root: str,
    *,
    dim: int,
    id_col: str,
    iterations: int = 3,
    name: str = "Faces",
    packed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Timed create / insert / delete of a collection, ``iterations`` times."""
    rt = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()

    def used_mb():
        return (rt.totalMemory() - rt.freeMemory()) / (1024.0**2)

    rows = []
    for i in range(iterations):
        coll = Collection(spark, root, f"{name}_{i}", dim=dim, id_col=id_col, packed=packed)
        coll.drop()
        m0 = used_mb()
        t0 = time.perf_counter()
        coll.create()
        t1 = time.perf_counter()
        m1 = used_mb()
        coll.append(data)
        t2 = time.perf_counter()
        m2 = used_mb()
        coll.drop()
        t3 = time.perf_counter()
        rows.append((i + 1, t1 - t0, t2 - t1, t3 - t2, m1 - m0, m2 - m1))
    cols = [
        "initialisation_time", "insertion_time", "deletion_time",
        "memory_usage_initialisation", "memory_usage_insertion",
    ]
    detail = spark.createDataFrame(rows, "iteration int, " + ", ".join(f"{c} double" for c in cols))
    summary = _summary(detail.withColumn("__run", F.lit(1)), cols, ["__run"]).drop("__run")
    return detail, summary
