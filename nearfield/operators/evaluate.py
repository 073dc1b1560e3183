"""Retrieval evaluation against labels.

The label table drives (D1): every labelled (target, item) row gets
``y_pred = 1`` when the item is among the hits of that target.  Hits without
a label are ignored, duplicate hits count once, duplicate label rows count
twice.  Zero denominators: precision, recall and F1 give 0.0 (the library
convention of the source); specificity, FAR and FRR give NULL where the
source has NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.ranking import running_sums


def labels_wide_to_long(
    wide: DataFrame,
    item_col: str,
    targets: list[str],
    target_col: str = "target",
    truth_col: str = "y_true",
) -> DataFrame:
    """Wide label table (one 0/1 column per target) -> (item, target, y_true)."""
    cols = [F.col(t).cast("int").alias(t) for t in targets]
    return wide.select(item_col, *cols).unpivot([item_col], targets, target_col, truth_col)


def predictions(
    labels_long: DataFrame,
    hits: DataFrame,
    item_col: str,
    target_col: str = "target",
    hit_item_col: str | None = None,
    hit_target_col: str | None = None,
) -> DataFrame:
    """Attach ``y_pred`` to every label row (D1): an existence test per
    (target, item), written as a left join to the distinct hit keys."""
    hit_keys = (
        hits.select(
            F.col(hit_target_col or target_col).alias(target_col),
            F.col(hit_item_col or item_col).alias(item_col),
        )
        .distinct()
        .withColumn("__hit", F.lit(1))
    )
    return (
        labels_long.join(hit_keys, [target_col, item_col], "left")
        .withColumn("y_pred", F.coalesce(F.col("__hit"), F.lit(0)))
        .drop("__hit")
    )


def labelled_hits(labels_long, hits, item_col, target_col="target", hit_item_col=None):
    """Label rows predicted positive (TP + FP), as a semi join."""
    keys = hits.select(
        F.col(target_col), F.col(hit_item_col or item_col).alias(item_col)
    )
    return labels_long.join(keys, [target_col, item_col], "left_semi")


def labelled_misses(labels_long, hits, item_col, target_col="target", hit_item_col=None):
    """Label rows predicted negative (FN + TN), as an anti join."""
    keys = hits.select(
        F.col(target_col), F.col(hit_item_col or item_col).alias(item_col)
    )
    return labels_long.join(keys, [target_col, item_col], "left_anti")


def _ratio(num, den, zero_as=None):
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return F.coalesce(r, F.lit(zero_as)) if zero_as is not None else r


def with_metrics(conf: DataFrame) -> DataFrame:
    """Add precision, recall, F1, specificity, FAR, FRR to tp/fp/fn/tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return conf.select(
        "*",
        _ratio(tp, tp + fp, 0.0).alias("precision"),
        _ratio(tp, tp + fn, 0.0).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1_score"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(fp, fp + tn).alias("far"),
        _ratio(fn, fn + tp).alias("frr"),
    )


def confusion(pred: DataFrame, group_cols, truth_col="y_true", pred_col="y_pred") -> DataFrame:
    """tn, fp, fn, tp per group (D3), as one partial aggregation."""
    t, p = F.col(truth_col) == 1, F.col(pred_col) == 1
    return pred.groupBy(*group_cols).agg(
        F.count_if(~t & ~p).cast("long").alias("tn"),
        F.count_if(~t & p).cast("long").alias("fp"),
        F.count_if(t & ~p).cast("long").alias("fn"),
        F.count_if(t & p).cast("long").alias("tp"),
    )


def evaluate(labels_long, hits, item_col, target_col="target", hit_item_col=None) -> DataFrame:
    """Confusion matrix and metrics per target."""
    pred = predictions(labels_long, hits, item_col, target_col, hit_item_col)
    return with_metrics(confusion(pred, [target_col]))


def class_sizes(collection: DataFrame, class_col: str) -> DataFrame:
    """(query_id = class, n_pos, n_all): the implied label table's counts."""
    sizes = collection.groupBy(F.col(class_col).cast("long").alias("query_id")).agg(
        F.count(F.lit(1)).cast("long").alias("n_pos")
    )
    # The total over the grouped table (one row per class), in the same pass.
    return sizes.withColumn("n_all", F.sum("n_pos").over(Window.partitionBy(F.lit(0))).cast("long"))


def evaluate_by_class(
    hits: DataFrame,
    collection: DataFrame,
    class_col: str,
    hit_class_col: str | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Evaluation when the label of (query, item) is "item has the query's class".

    The implied label table has one row per (class, item); it is never built.
    With the per-class counts of the collection and the hits (which carry the
    class of the hit item) the four cells follow from two aggregations:
    tp = hits of the own class, fp = other hits, fn = class size - tp,
    tn = (collection size - class size) - fp.  Queries are keyed by class.
    ``sizes`` (from ``class_sizes``) can be computed once and reused.
    """
    hc = hit_class_col or class_col
    per_q = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_hits"),
        F.count_if(F.col(hc).cast("long") == F.col("query_id")).cast("long").alias("tp"),
    )
    if sizes is None:
        sizes = class_sizes(collection, class_col)
    j = sizes.join(per_q, "query_id", "left").fillna(0, ["n_hits", "tp"])
    conf = j.select(
        "query_id",
        "n_hits",
        "tp",
        (F.col("n_hits") - F.col("tp")).alias("fp"),
        (F.col("n_pos") - F.col("tp")).alias("fn"),
        (F.col("n_all") - F.col("n_pos") - (F.col("n_hits") - F.col("tp"))).alias("tn"),
    )
    return with_metrics(conf)


def degenerate_flags(pred: DataFrame, group_cols, truth_col="y_true", pred_col="y_pred"):
    """One-class input (all truths and predictions equal).  The source
    fails such a request; here metrics are computed and the case is flagged."""
    return pred.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("long").alias("n_labelled"),
        F.sum(F.col(truth_col)).cast("long").alias("n_true"),
        F.sum(F.col(pred_col)).cast("long").alias("n_pred"),
        (
            (F.min(truth_col) == F.max(truth_col))
            & (F.min(pred_col) == F.max(pred_col))
            & (F.min(truth_col) == F.min(pred_col))
        ).alias("is_degenerate"),
    )


def average_precision(ranked: DataFrame, positives: DataFrame, rel_col="rel") -> DataFrame:
    """Mean-average-precision building block.

    ``ranked``: (query_id, rank, rel 0/1), one row per hit, rank 1..k.
    ``positives``: (query_id, n_pos).  AP = sum(precision@k * rel_k) / n_pos;
    NULL when a query has no positives.  The running sum is a window per
    query over at most ``limit`` ranked hits.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per_hit = ranked.withColumn("__cum", F.sum(F.col(rel_col)).over(w)).withColumn(
        "__p_at_k", F.col("__cum").cast("double") / F.col("rank").cast("double")
    )
    s = per_hit.groupBy("query_id").agg(
        F.sum(F.when(F.col(rel_col) == 1, F.col("__p_at_k")).otherwise(F.lit(0.0))).alias("__s")
    )
    return (
        positives.join(s, "query_id", "left")
        .select(
            "query_id",
            F.col("n_pos").cast("long").alias("n_pos"),
            F.try_divide(F.coalesce(F.col("__s"), F.lit(0.0)), F.col("n_pos").cast("double")).alias(
                "average_precision"
            ),
        )
    )


def threshold_sweep(scored: DataFrame, group_cols, score_col="score", truth_col="y_true") -> DataFrame:
    """Tp, fp, fn, precision and recall at every distinct score used as the cut-off.

    ``scored``: one row per scored, labelled item.  Rows are first counted per
    distinct score; the running sums from the highest score down are spread by
    range over (group, score), so no query is one task.  Recall is NULL for a
    group without positives.  Rows without a score are left out (never hits),
    but their positives still count as missed.
    """
    group_cols = list(group_cols)
    positives = scored.groupBy(*group_cols).agg(F.sum(F.col(truth_col).cast("long")).alias("__pos"))
    counted = scored.where(F.col(score_col).isNotNull()).groupBy(*group_cols, F.col(score_col).alias("threshold")).agg(
        F.sum(F.col(truth_col).cast("long")).alias("__tp"), F.count(F.lit(1)).alias("__n")
    )
    swept = running_sums(counted, group_cols, [F.desc("threshold")], {"tp": "__tp", "__all": "__n"})
    names = {c: f"__q{i}" for i, c in enumerate(group_cols)}
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = swept.join(positives.withColumnsRenamed(names), same).drop(*names.values())
    return out.select(
        *group_cols,
        "threshold",
        "tp",
        (F.col("__all") - F.col("tp")).alias("fp"),
        (F.col("__pos") - F.col("tp")).alias("fn"),
        (F.col("tp") / F.col("__all")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("__pos").cast("double")).alias("recall"),
        F.col("__tp").alias("tp_here"),
    )


def mean_average_precision(sweep: DataFrame, group_cols) -> DataFrame:
    """Average precision of each group over a sweep, sum of precision x gained recall, and its mean over groups with positives."""
    ap = sweep.groupBy(*group_cols).agg(
        (F.sum(F.col("precision") * F.col("tp_here")) / F.nullif(F.max(F.col("tp") + F.col("fn")), F.lit(0))).alias("ap")
    )
    return ap.agg(F.count("ap").alias("n_queries"), F.avg("ap").alias("mean_average_precision"))
