"""Positions within ordered groups without a single-task window.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task; when
one group holds a third of all rows that task is the job.  ``positions``
computes the same 0-based ``row_number() - 1`` with a range shuffle instead:

1. ``repartitionByRange(group..., order...)`` + ``sortWithinPartitions``
   spreads a hot group over many partitions, in order;
2. ``monotonically_increasing_id`` minus the partition's base gives the row's
   place in its sorted partition;
3. a table of counts per (group, partition) - groups x partitions rows, never
   data-sized - turns that into the rank inside the group.

The sorted data is checkpointed once (reliable checkpoint in the cluster's
checkpoint folder), so the counts and the rows come from the same copy.

NULL group keys form a group of their own on every path.  The order columns should make the order total (add a unique tiebreaker), so
that a recomputed partition after an executor loss yields the same ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import checkpoint_dir


def positions(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list,
    out_col: str = "pos",
    num_partitions: int | None = None,
    with_group_size: str | None = None,
) -> DataFrame:
    """Add ``out_col`` = 0-based position of each row inside its group."""
    spark = df.sparkSession
    nparts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    ranked = (
        df.repartitionByRange(nparts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__local", F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33))
    )
    # Both uses below must see the same partitioning: range bounds come from a
    # sample whose seed depends on the RDD, so two evaluations can disagree.
    # A reliable checkpoint (shared checkpoint folder) fixes one copy.
    checkpoint_dir(spark)
    ranked = ranked.checkpoint(eager=True)
    counts = ranked.groupBy(*group_cols, "__pid").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__local").alias("__first")
    )
    if group_cols:
        wg = Window.partitionBy(*group_cols).orderBy("__pid")
        starts = counts.withColumn("__start", F.sum("__c").over(wg) - F.col("__c"))
        if with_group_size:
            starts = starts.withColumn(
                with_group_size, F.sum("__c").over(Window.partitionBy(*group_cols)).cast("long")
            )
    else:
        # One row per sorted partition: summed on the driver, not in a one-task window.
        rows, start = [], 0
        for r in sorted(counts.collect(), key=lambda r: r["__pid"]):
            rows.append((r["__pid"], r["__first"], start))
            start += r["__c"]
        starts = spark.createDataFrame(rows, "__pid int, __first long, __start long")
        if with_group_size:
            starts = starts.withColumn(with_group_size, F.lit(start).cast("long"))
    # Group keys may be NULL; they are matched null-safely.
    names = {c: f"__g{i}" for i, c in enumerate(group_cols)}
    starts = starts.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        F.col("__pid").alias("__p"),
        "__start",
        "__first",
        *([with_group_size] if with_group_size else []),
    )
    same = F.col("__pid") == F.col("__p")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = ranked.join(starts, same).withColumn(
        out_col, (F.col("__start") + F.col("__local") - F.col("__first")).cast("long")
    )
    return out.drop("__pid", "__mid", "__local", "__start", "__first", "__p", *names.values())


# Largest group handled inside one task (window, built-in percentile); a
# bigger group - e.g. one key with a third of all rows - takes the range
# shuffle of ``positions``.
SINGLE_TASK_GROUP_ROWS = 2_000_000


def max_group_rows(df: DataFrame, group_cols) -> int:
    """Row count of the largest group (one small aggregate job)."""
    if not group_cols:
        return int(df.count())
    r = df.groupBy(*group_cols).count().agg(F.max("count")).first()[0]
    return int(r or 0)


def fits_one_task(df: DataFrame, group_cols, single_task_rows: int | None = None) -> bool:
    limit = SINGLE_TASK_GROUP_ROWS if single_task_rows is None else single_task_rows
    return max_group_rows(df, list(group_cols)) <= limit


def ordered_positions(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list,
    out_col: str = "pos",
    single_task_rows: int | None = None,
) -> DataFrame:
    """``positions`` with a measured choice of strategy: when the largest group
    fits in one task, a ``row_number`` window; otherwise, and always for no
    groups, the range shuffle, which never holds a group in one task."""
    if group_cols and fits_one_task(df, group_cols, single_task_rows):
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        return df.withColumn(out_col, (F.row_number().over(w) - 1).cast("long"))
    return positions(df, group_cols, order_cols, out_col)


def _by_range(df: DataFrame, keys: list) -> DataFrame:
    """Rows in range partitions by ``keys``, sorted, with the partition's number; one fixed copy (see ``positions``)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__pid", F.spark_partition_id())
    return ranged.checkpoint(eager=True)


def _with_carried(ranged: DataFrame, carried: DataFrame, group_cols: list[str]) -> DataFrame:
    """Join what earlier partitions leave to a group (a row per partition and group) to the group's rows, null-safely."""
    names = {c: f"__g{i}" for i, c in enumerate(group_cols)}
    side = carried.withColumnsRenamed({**names, "__pid": "__p"})
    same = F.col("__pid") == F.col("__p")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return ranged.join(side, same, "left").drop("__p", *names.values())


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list, sums: dict[str, str]) -> DataFrame:
    """Add running sums (new column -> summed column) over the rows of each group in order.

    Rows are spread by range over (group, order); a partition's rows are
    summed by themselves and start from the totals of the partitions before it, so
    a group with a third of all rows is many tasks.  Rows of a group must differ
    in the order columns.
    """
    ranged = _by_range(df, [*group_cols, *order_cols])
    totals = ranged.groupBy(*group_cols, "__pid").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group_cols, "__pid", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    here = Window.partitionBy("__pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(here).alias(n) for n, c in sums.items()])
    out = _with_carried(local, carried, group_cols)
    return out.withColumns({n: F.col(n) + F.col(f"__s_{n}") for n in sums}).drop("__pid", *[f"__s_{n}" for n in sums])


def last_before(samples: DataFrame, probes: DataFrame, group_cols: list[str], time_col: str, value_cols: list[str]) -> DataFrame:
    """As-of join: each probe with the values of its group's latest sample at or before its time.

    Samples and probes are spread together by range over (group, time); what
    a group's earlier partitions saw last is carried to the later ones.  A
    group has at most one sample per time (others of that time are dropped in
    favour of the greatest values); probes without an earlier sample get nulls.
    """
    value = F.struct(*[F.col(c) for c in value_cols])
    points = samples.groupBy(*group_cols, time_col).agg(F.max(value).alias("__v"))
    rest = [c for c in probes.columns if c not in (*group_cols, time_col)]
    both = points.withColumns({"__probe": F.lit(0), **{c: F.lit(None).cast(probes.schema[c].dataType) for c in rest}}).unionByName(
        probes.withColumn("__v", F.lit(None).cast(points.schema["__v"].dataType)).withColumn("__probe", F.lit(1))
    )
    ranged = _by_range(both, [*group_cols, time_col, "__probe"])
    last = ranged.groupBy(*group_cols, "__pid").agg(F.max_by("__v", F.when(F.col("__probe") == 0, F.col(time_col))).alias("__l"))
    before = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*group_cols, "__pid", F.last("__l", ignorenulls=True).over(before).alias("__c"))
    here = Window.partitionBy("__pid", *group_cols).orderBy(time_col, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("__v", F.last("__v", ignorenulls=True).over(here))
    out = _with_carried(seen.filter("__probe = 1"), carried, group_cols).withColumn("__v", F.coalesce("__v", "__c"))
    return out.select(*probes.columns, *[F.col(f"__v.{c}").alias(c) for c in value_cols])
