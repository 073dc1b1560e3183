"""Benchmark statistics over request logs.

Mean and population standard deviation are ordinary partial aggregates.
Percentiles use linear interpolation between order statistics (the numpy
default), computed exactly.  The largest group is measured first: if every
group fits in one task, Spark's exact ``percentile`` / windows are used;
otherwise no group is held in one task:

ranks inside each group come from ``ranking.positions`` (a range shuffle
that spreads a hot group over many partitions), and only the rows at the
two ranks around ``p * (n - 1)`` are kept and interpolated.

Nothing but the requested order statistics leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import seconds_between
from nearfield.operators.ranking import fits_one_task, positions

DEFAULT_PERCENTILES = (90, 95, 99)


def exact_percentiles(
    df: DataFrame,
    value_col: str,
    group_cols: list[str],
    percentiles=DEFAULT_PERCENTILES,
    num_partitions: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Interpolated percentiles per group: one column ``p{p}`` per percentile.

    Groups that all fit in one task use Spark's exact ``percentile``; if any
    group is larger, ranks come from the range shuffle of ``positions``.
    """
    vals = df.select(*group_cols, F.col(value_col).cast("double").alias("__v")).where(
        F.col("__v").isNotNull()
    )
    if fits_one_task(vals, group_cols, single_task_rows):
        ps = [float(p) / 100.0 for p in percentiles]
        agg = vals.groupBy(*group_cols).agg(F.percentile("__v", F.lit(ps)).alias("__p"))
        return agg.select(
            *group_cols, *[F.col("__p")[i].alias(f"p{p}") for i, p in enumerate(percentiles)]
        )
    # Equal values are told apart by an arbitrary row number, so that a value
    # held by most rows of a group is still spread over the partitions.
    with_rank = positions(
        vals.withColumn("__t", F.monotonically_increasing_id()),
        group_cols, ["__v", "__t"], "__rank", num_partitions=num_partitions, with_group_size="__n",
    )
    wanted = []
    for p in percentiles:
        pos = (F.col("__n") - 1).cast("double") * F.lit(float(p) / 100.0)
        wanted.append(
            F.struct(
                F.lit(p).alias("p"),
                F.floor(pos).cast("long").alias("lo"),
                F.ceil(pos).cast("long").alias("hi"),
                (pos - F.floor(pos)).alias("frac"),
            )
        )
    needed = with_rank.where(
        F.exists(F.array(*wanted), lambda w: (F.col("__rank") == w["lo"]) | (F.col("__rank") == w["hi"]))
    )
    picked = needed.select(
        *group_cols, "__rank", "__v", F.explode(F.array(*wanted)).alias("__w")
    ).where((F.col("__rank") == F.col("__w.lo")) | (F.col("__rank") == F.col("__w.hi")))
    per_p = picked.groupBy(*group_cols, F.col("__w.p").alias("__p")).agg(
        F.max(F.when(F.col("__rank") == F.col("__w.lo"), F.col("__v"))).alias("__lo"),
        F.max(F.when(F.col("__rank") == F.col("__w.hi"), F.col("__v"))).alias("__hi"),
        F.first("__w.frac").alias("__f"),
    )
    val = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")
    return per_p.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("__p") == p, val)).alias(f"p{p}") for p in percentiles]
    )


def latency_summary(
    df: DataFrame,
    value_col: str,
    group_cols: list[str],
    percentiles=DEFAULT_PERCENTILES,
    prefix: str = "",
    single_task_rows: int | None = None,
) -> DataFrame:
    """n, mean, population std and percentiles per group (E1-E3, E8); a NULL key is a group."""
    base = df.groupBy(*group_cols).agg(
        F.count(F.col(value_col)).cast("long").alias(f"{prefix}n"),
        F.avg(F.col(value_col).cast("double")).alias(f"{prefix}mean"),
        F.stddev_pop(F.col(value_col).cast("double")).alias(f"{prefix}std"),
    )
    pct = exact_percentiles(df, value_col, group_cols, percentiles, single_task_rows=single_task_rows)
    return _join_null_safe(base, pct, group_cols, {f"p{p}": f"{prefix}p{p}" for p in percentiles})


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], add: dict[str, str]) -> DataFrame:
    """Left join on keys that may be NULL; ``add`` maps columns of ``right`` to their names in the result."""
    sides = right.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"__a{i}") for i, c in enumerate(add)]
    )
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return left.join(sides, same, "left").select(
        *[F.col(c) for c in left.columns], *[F.col(f"__a{i}").alias(n) for i, n in enumerate(add.values())]
    )


def summary_long(wide: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """Wide statistics -> (id..., metric, value)."""
    cols = [F.col(c).cast("double").alias(c) for c in metric_cols]
    return wide.select(*id_cols, *cols).unpivot(id_cols, metric_cols, "metric", "value")


def throughput(df: DataFrame, group_cols, ts_col: str, ok_col: str) -> DataFrame:
    """Successful requests / elapsed seconds per run, 0 when elapsed is 0."""
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("long").alias("total_requests"),
        F.count_if(F.col(ok_col)).cast("long").alias("successful_requests"),
        seconds_between(F.min(ts_col), F.max(ts_col)).alias("elapsed_s"),
    )
    return agg.withColumn(
        "rps",
        F.when(F.col("elapsed_s") > 0, F.col("successful_requests") / F.col("elapsed_s")).otherwise(
            F.lit(0.0)
        ),
    )


def iteration_numbers(
    df: DataFrame, run_cols, order_cols, ok_col: str, single_task_rows: int | None = None
) -> DataFrame:
    """Iteration = 1-based completion order within a run over all requests;
    failed requests are then dropped, leaving gaps (E9).  Runs that fit in one
    task are numbered by a window; a longer run takes the range shuffle."""
    if run_cols and fits_one_task(df, list(run_cols), single_task_rows):
        w = Window.partitionBy(*run_cols).orderBy(*order_cols)
        out = df.withColumn("iteration", F.row_number().over(w).cast("long"))
        return out.where(F.col(ok_col))
    out = positions(df, list(run_cols), list(order_cols), "__pos")
    return out.withColumn("iteration", F.col("__pos") + 1).drop("__pos").where(F.col(ok_col))


def phase_durations(df: DataFrame, key_cols, ts_col: str) -> DataFrame:
    """First and last timestamp per key and the seconds between them."""
    return df.groupBy(*key_cols).agg(
        F.min(ts_col).alias("start_ts"),
        F.max(ts_col).alias("end_ts"),
        F.count(F.lit(1)).cast("long").alias("n_events"),
    ).withColumn("duration_s", seconds_between("start_ts", "end_ts"))


def deltas(
    df: DataFrame, key_cols, order_cols, value_col: str, out_col: str = "delta",
    single_task_rows: int | None = None,
):
    """``value - previous value`` per key in order (E5 on a logged series).

    Keys that fit in one task use ``lag`` over a window; if any key is larger
    it is a join of each row to its predecessor on (key, position), so a key
    with a third of all rows is spread by position, not one window task.
    """
    key_cols = list(key_cols)
    if key_cols and fits_one_task(df, key_cols, single_task_rows):
        w = Window.partitionBy(*key_cols).orderBy(*order_cols)
        return df.withColumn(out_col, F.col(value_col) - F.lag(value_col).over(w))
    p = positions(df, key_cols, list(order_cols), "__pos")
    prev = p.select(
        *key_cols, (F.col("__pos") + 1).alias("__pos"), F.col(value_col).alias("__prev")
    )
    joined = _join_null_safe(p, prev, [*key_cols, "__pos"], {"__prev": "__prev"})
    return joined.withColumn(out_col, F.col(value_col) - F.col("__prev")).drop("__prev", "__pos")


def quantile_sketches(df: DataFrame, value_col: str, group_cols) -> DataFrame:
    """One KLL sketch per group (E3 at scale): a few kilobytes that can be written, and merged without the rows.

    NULLs are left out; a group without values has a NULL sketch.
    """
    return df.groupBy(*group_cols).agg(F.kll_sketch_agg_double(F.col(value_col).cast("double")).alias("sketch"), F.count(value_col).alias("n"))


def merged_quantiles(sketches: DataFrame, group_cols, percents=(90, 95, 99)) -> DataFrame:
    """Percentiles of each group from the merged sketches of its runs; ranks are right to about 1.3 %."""
    merged = sketches.groupBy(*group_cols).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*group_cols, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in percents])
