"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole tables (or data Spark derives from them).  Computed
doubles that depend on summation order are rounded to 6 decimals so the
DuckDB oracle can be compared value by value; ratios of counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import ts_file_text
from nearfield.operators import evaluate as EV
from nearfield.operators import stats as ST
from nearfield.operators.report import QUALITY_METRICS, quality_table
from nearfield.operators.search import ScoreRule, class_prototypes, hits_to_names, profile, search, search_profile
from nearfield.plans import catalog as C

COS = ScoreRule("cosine", "identity")
R = 6  # decimals of order-dependent doubles


def _r(col: str, name: str | None = None):
    return F.round(F.col(col), R).alias(name or col)


def class_hits(spark, sf_dir, **kw) -> DataFrame:
    coll = C.collection(spark, sf_dir)
    args = dict(rule=COS, cutoff=C.THRESHOLD, limit=C.LIMIT, id_col="vec_id", carry=())
    args.update(kw)
    return search(coll, C.class_queries(coll), **args)


def doc_hits(spark, sf_dir) -> DataFrame:
    vecs = C.doc_vectors_once(spark, sf_dir)
    hits = search(
        vecs,
        C.doc_target_queries(spark, sf_dir, vecs),
        rule=COS,
        cutoff=C.DOC_THRESHOLD,
        limit=C.LIMIT,
        id_col="doc_id",
    )
    return hits.withColumn("target", C.target_name(F.col("query_id")))


# -- step 1: search and evaluate ------------------------------------------------


def flagship_search_eval(spark, sf_dir) -> DataFrame:
    """Class-prototype queries -> exact cosine search (>= 0.2, top 10000)
    -> confusion matrix and metrics per query."""
    coll = C.collection(spark, sf_dir)
    hits = class_hits(spark, sf_dir, carry=("label",))
    return EV.evaluate_by_class(hits, coll, "label")


def exact_threshold_search(spark, sf_dir) -> DataFrame:
    h = class_hits(spark, sf_dir)
    return h.select("query_id", "vec_id", _r("score"), "rank")


def batch_knn_topk(spark, sf_dir) -> DataFrame:
    h = class_hits(spark, sf_dir, cutoff=None, limit=C.TOPK)
    return h.select("query_id", "vec_id", _r("score"), "rank")


N_MANY = 25


def batch_knn_many(spark, sf_dir) -> DataFrame:
    """A large request set: one prototype per (label, vec_id % 25), up to 10,000 hits
    each, so that queries x limit passes the per-task top-k state and is sliced."""
    coll = C.collection(spark, sf_dir)
    keyed = coll.withColumn("query_id", F.col("label").cast("long") * N_MANY + F.col("vec_id") % N_MANY)
    queries = class_prototypes(keyed, "query_id", "embedding")
    h = search(coll, queries, rule=COS, limit=C.LIMIT, id_col="vec_id")
    return h.select("query_id", "vec_id", _r("score"), "rank")


def hits_basename(spark, sf_dir) -> DataFrame:
    """Hits -> item paths (pages.url by id) -> non-empty base names."""
    h = class_hits(spark, sf_dir)
    paths = C.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("vec_id"), F.col("url").alias("image_path")
    )
    # Hits without a page stay until the drop-empty rule removes them.
    named = hits_to_names(h.join(paths, "vec_id", "left"), "image_path", drop_empty=True)
    return named.select("query_id", "vec_id", "rank", "base_name")


def labelled_hits_semi(spark, sf_dir) -> DataFrame:
    labels = C.doc_labels_long(spark, sf_dir)
    return EV.labelled_hits(labels, doc_hits(spark, sf_dir), "doc_id")


def labelled_misses_anti(spark, sf_dir) -> DataFrame:
    labels = C.doc_labels_long(spark, sf_dir)
    return EV.labelled_misses(labels, doc_hits(spark, sf_dir), "doc_id")


# -- step 2: store profiles (native score, cut-off, limit) -------------------------


def _profile_hits(spark, sf_dir, prof):
    coll = C.collection(spark, sf_dir)
    h = search_profile(coll, C.class_queries(coll), prof, id_col="vec_id")
    return h.select("query_id", "vec_id", _r("score"), "rank")


def search_profile_cosine(spark, sf_dir):
    """``s >= c`` (pgvector, Qdrant rule) with the store's own cut-off 0 and limit 1,600 (C14)."""
    return _profile_hits(spark, sf_dir, profile("pgvector"))


def search_profile_post_filter(spark, sf_dir):
    """Top-k first, then ``s >= t`` (Milvus rule); k = 50 binds here."""
    return _profile_hits(spark, sf_dir, profile("milvus", cutoff=C.THRESHOLD, limit=50))


def search_profile_half_shift(spark, sf_dir):
    """``(1 + s) / 2 >= c`` (Weaviate, Elasticsearch rule); c = 0.6 <=> s >= 0.2."""
    return _profile_hits(spark, sf_dir, profile("weaviate", cutoff=0.6, limit=C.LIMIT))


def search_profile_distance(spark, sf_dir):
    """``1 - s <= t`` (Chroma rule); t = 0.8 <=> s >= 0.2."""
    return _profile_hits(spark, sf_dir, profile("chroma", cutoff=0.8))


# -- step 3: metrics and scalar pre-filter --------------------------------------


def metric_inner_product(spark, sf_dir):
    h = class_hits(spark, sf_dir, rule=ScoreRule("ip"), cutoff=None, limit=C.TOPK)
    return h.select("query_id", "vec_id", _r("score"), "rank")


def metric_l2(spark, sf_dir):
    h = class_hits(spark, sf_dir, rule=ScoreRule("l2"), cutoff=None, limit=C.TOPK)
    return h.select("query_id", "vec_id", _r("score"), "rank")


PREFILTER = "label BETWEEN 3 AND 6"


def prefiltered_search(spark, sf_dir):
    h = class_hits(spark, sf_dir, prefilter=PREFILTER, carry=("label",))
    return h.select("query_id", "vec_id", _r("score"), "rank", "label")


# -- step 4: multi-target evaluation, degenerate flags, average precision -------


def _doc_pred(spark, sf_dir):
    return EV.predictions(C.doc_labels_long(spark, sf_dir), doc_hits(spark, sf_dir), "doc_id")


def confusion_multi_target(spark, sf_dir):
    return EV.with_metrics(EV.confusion(_doc_pred(spark, sf_dir), ["target"]))


def degenerate_class_flags(spark, sf_dir):
    """Besides the two targets a third, ``unsought``: nobody has it and no query asks for it."""
    labels = C.doc_labels_long(spark, sf_dir)
    third = C.table(spark, sf_dir, "labels").select("doc_id", F.lit("unsought").alias("target"), F.lit(0).alias("y_true"))
    pred = EV.predictions(labels.unionByName(third), doc_hits(spark, sf_dir), "doc_id")
    return EV.degenerate_flags(pred, ["target"])


def average_precision(spark, sf_dir):
    coll = C.collection(spark, sf_dir)
    h = class_hits(spark, sf_dir, carry=("label",))
    ranked = h.select(
        "query_id", "rank", (F.col("label").cast("long") == F.col("query_id")).cast("int").alias("rel")
    )
    pos = coll.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.count(F.lit(1)).alias("n_pos")
    )
    ap = EV.average_precision(ranked, pos)
    return ap.select("query_id", "n_pos", _r("average_precision"))


# quality by store and dataset.  Stores differ in their rule and limit.
REPORT_STORES = {"PGVECTOR": C.LIMIT, "MILVUS": 50}


def report_quality(spark, sf_dir):
    """All six quality metrics by store x dataset, averaged over the queries."""
    coll = C.collection(spark, sf_dir)
    queries = C.class_queries(coll)
    vecs = C.doc_vectors_once(spark, sf_dir)
    doc_queries = C.doc_target_queries(spark, sf_dir, vecs)
    labels = C.doc_labels_long(spark, sf_dir)
    out = None
    for store, limit in REPORT_STORES.items():
        prof = profile(store, cutoff=C.THRESHOLD, limit=limit)
        hits = search_profile(coll, queries, prof, id_col="vec_id", carry=("label",))
        doc_prof = profile(store, cutoff=C.DOC_THRESHOLD, limit=limit)
        doc = search_profile(vecs, doc_queries, doc_prof, id_col="doc_id")
        doc = doc.withColumn("target", C.target_name(F.col("query_id")))
        for dataset, evaluated in (
            ("embeddings", EV.evaluate_by_class(hits, coll, "label")),
            ("documents", EV.evaluate(labels, doc, "doc_id")),
        ):
            part = evaluated.select(F.lit(store).alias("database"), F.lit(dataset).alias("dataset"), *QUALITY_METRICS)
            out = part if out is None else out.unionByName(part)
    q = quality_table(out)
    return q.select("database", "dataset", "n_queries", *[_r(m) for m in QUALITY_METRICS])


# -- step 5/6: request-log statistics ---------------------------------------------


def _requests(spark, sf_dir):
    ev = C.table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        (F.col("event_type") != F.lit("error")).alias("ok"),
    )


STAT_COLS = ["n", "mean", "std", "p90", "p95", "p99"]


def latency_summary_wide(spark, sf_dir):
    ok = _requests(spark, sf_dir).where("ok")
    w = ST.latency_summary(ok, "value", ["event_type"])
    return w.select("event_type", "n", *[_r(c) for c in STAT_COLS[1:]])


def latency_summary_long(spark, sf_dir):
    ok = _requests(spark, sf_dir).where("ok")
    w = ST.latency_summary(ok, "value", ["event_type"])
    lng = ST.summary_long(w, ["event_type"], STAT_COLS)
    return lng.select("event_type", "metric", _r("value"))


def stats_null_group(spark, sf_dir):
    """Statistics with a nullable group key (errors have no store), by the one-task
    path and by the range path."""
    rows = _requests(spark, sf_dir).withColumn("store", F.expr("nullif(event_type, 'error')"))
    out = None
    for path, single_task_rows in (("window", None), ("range", 0)):
        w = ST.latency_summary(rows, "value", ["store"], single_task_rows=single_task_rows)
        it = ST.iteration_numbers(rows, ["store"], ["ts", "event_id"], "ok", single_task_rows=single_task_rows)
        last = it.groupBy(F.col("store").alias("s")).agg(F.max("iteration").alias("last_iteration"))
        got = w.join(last, F.col("store").eqNullSafe(F.col("s")), "left").select(
            F.lit(path).alias("path"), "store", "n", *[_r(c) for c in STAT_COLS[1:]], "last_iteration"
        )
        out = got if out is None else out.unionByName(got)
    return out


def throughput_by_store(spark, sf_dir):
    t = ST.throughput(_requests(spark, sf_dir), ["event_type"], "ts", "ok")
    return t.select(
        "event_type", "total_requests", "successful_requests", _r("elapsed_s"), _r("rps")
    )


def iteration_numbering(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("run_day", F.to_date("ts"))
    it = ST.iteration_numbers(r, ["run_day"], ["ts", "event_id"], "ok")
    return it.select(F.col("run_day").cast("string").alias("run_day"), "event_id", "iteration")


def phase_durations(spark, sf_dir):
    d = ST.phase_durations(_requests(spark, sf_dir), ["user_id"], "ts")
    return d.select(
        "user_id",
        ts_file_text("start_ts").alias("start_text"),
        ts_file_text("end_ts").alias("end_text"),
        "n_events",
        _r("duration_s"),
    )


def memory_delta(spark, sf_dir):
    d = ST.deltas(_requests(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")
    return d.select("user_id", "event_id", _r("delta"))


QUERIES = {
    "flagship_search_eval": flagship_search_eval,
    "exact_threshold_search": exact_threshold_search,
    "batch_knn_topk": batch_knn_topk,
    "batch_knn_many": batch_knn_many,
    "hits_basename": hits_basename,
    "labelled_hits_semi": labelled_hits_semi,
    "labelled_misses_anti": labelled_misses_anti,
    "search_profile_cosine": search_profile_cosine,
    "search_profile_post_filter": search_profile_post_filter,
    "search_profile_half_shift": search_profile_half_shift,
    "search_profile_distance": search_profile_distance,
    "metric_inner_product": metric_inner_product,
    "metric_l2": metric_l2,
    "prefiltered_search": prefiltered_search,
    "confusion_multi_target": confusion_multi_target,
    "degenerate_class_flags": degenerate_class_flags,
    "average_precision": average_precision,
    "report_quality": report_quality,
    "latency_summary_wide": latency_summary_wide,
    "latency_summary_long": latency_summary_long,
    "stats_null_group": stats_null_group,
    "throughput_by_store": throughput_by_store,
    "iteration_numbering": iteration_numbering,
    "phase_durations": phase_durations,
    "memory_delta": memory_delta,
}
