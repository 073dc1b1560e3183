"""Registered queries for searches with measured recall, bounded cells, and requests of many stores.

Queries are all rows whose ``vec_id`` is divisible by 100, against all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield.operators import stats as ST
from nearfield.operators.ann import build_ivf, ivf_search, load_ivf, save_ivf
from nearfield.operators.codes import build_codes, code_search, load_codes, save_codes, scanned_bytes
from nearfield.operators.probes import (
    build_multi_lsh,
    bounded_search,
    load_bounded,
    load_multi_lsh,
    multi_lsh_search,
    pooled_recall,
    save_bounded,
    save_multi_lsh,
    tune,
    with_reach,
)
from nearfield.operators.evaluate import mean_average_precision, threshold_sweep
from nearfield.operators.ranking import last_before
from nearfield.operators.scoring import Metric, register_metric
from nearfield.operators.search import (
    Profile,
    ScoreRule,
    register_profile,
    search,
    search_request,
    search_requests,
    with_store_rules,
)
from nearfield.plans import catalog as C
from nearfield.plans.oracles import PROTOS, R
from nearfield.plans.queries import COS
from nearfield.session import scratch_path

K = 10
# Cut-off of the search over codes.
NEAR = 0.3
# Cut-off of the Manhattan search.
REACH = 7.6
TABLES, BITS = 6, 6
RECALL = 0.9


def _row_queries(coll):
    return coll.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _exact(coll, queries):
    return search(coll, queries, rule=COS, limit=K, id_col="vec_id")


def _class_cells(spark, coll):
    """Cells around the class prototypes, with their reach, written and read back."""
    protos = C.class_queries(coll).orderBy("query_id").collect()  # a row per class
    path = scratch_path(spark, "cells")
    save_bounded(with_reach(build_ivf(coll, len(protos), centroids=[r["embedding"] for r in protos])), path)
    return path


def ivf_bounded_topk(spark, sf_dir):
    """Cells in order of their bound until none can hold a better hit: the exact ten nearest."""
    coll = C.collection(spark, sf_dir)
    index = load_bounded(spark, _class_cells(spark, coll))
    h = bounded_search(index, _row_queries(coll), rule=COS, limit=K, id_col="vec_id")
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


def ivf_bounded_cutoff(spark, sf_dir):
    """The same with a cut-off: cells whose bound is below it are not read."""
    coll = C.collection(spark, sf_dir)
    index = load_bounded(spark, _class_cells(spark, coll))
    h = bounded_search(index, _row_queries(coll), rule=COS, cutoff=C.THRESHOLD, limit=C.LIMIT, id_col="vec_id")
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


def _report(coll, approx):
    """Queries, exact hits, and whether the recall over all of them reaches RECALL."""
    queries = _row_queries(coll)
    found, k = pooled_recall(approx, _exact(coll, queries), "vec_id")
    return queries.agg(F.count(F.lit(1)).alias("n_queries")).select(
        "n_queries", F.lit(k).cast("long").alias("n_hits"), F.lit(found >= RECALL * k).alias("reached")
    )


def lsh_recall(spark, sf_dir):
    """Several hash tables, cells in order of margin; probes tuned on a sample, recall measured on all row queries."""
    coll = C.collection(spark, sf_dir)
    path = scratch_path(spark, "multi-lsh")
    save_multi_lsh(build_multi_lsh(coll, TABLES, BITS, dim=64), path)
    index = load_multi_lsh(spark, path)

    def run(queries, n):
        return multi_lsh_search(index, queries, n, rule=COS, limit=K, id_col="vec_id")

    queries = _row_queries(coll)
    probes = tune(run, lambda q: _exact(coll, q), queries, (4, 8, 12, 16, 24, 32, 57), "vec_id")
    return _report(coll, run(queries, probes))


def ivf_recall(spark, sf_dir):
    """Cells probed by nearness, their number tuned on a sample; recall on all row queries."""
    coll = C.collection(spark, sf_dir)
    index = load_ivf(spark, _class_cells(spark, coll))

    def run(queries, n):
        return ivf_search(index, queries, n, rule=COS, limit=K, id_col="vec_id")

    queries = _row_queries(coll)
    nprobe = tune(run, lambda q: _exact(coll, q), queries, range(2, index.n_cells + 1), "vec_id")
    return _report(coll, run(queries, nprobe))


def pool_recall(spark, sf_dir):
    """A candidate pool tuned on a sample; recall on all row queries."""
    coll = C.collection(spark, sf_dir)
    path = scratch_path(spark, "pool-cells")
    protos = C.class_queries(coll).orderBy("query_id").collect()
    save_ivf(build_ivf(coll, len(protos), centroids=[r["embedding"] for r in protos]), path)
    index = load_ivf(spark, path)

    def run(queries, n):
        return ivf_search(index, queries, num_candidates=n, rule=COS, limit=K, id_col="vec_id")

    queries = _row_queries(coll)
    n_rows = int(index.counts.sum())
    pools = [max(100, n_rows * i // 10) for i in range(1, 11)]
    pool = tune(run, lambda q: _exact(coll, q), queries, pools, "vec_id")
    return _report(coll, run(queries, pool))


#: The published request of each store, with cut-offs that select rows of the test table.
STORE_REQUESTS = {
    "pgvector": {"certainty": 0.2, "limit": 10000},
    "qdrant": {"certainty": 0.25, "limit": 20},
    "milvus": {"anns_field": "embedding", "metric_type": "COSINE", "index_params": {"ef": 10000}, "limit": None, "threshold": 0.2, "output_fields": ["id", "image_path"]},
    "weaviate": {"certainty": 0.6, "limit": 10000},
    "chroma": {"threshold": 0.75, "limit": 50},
    "elasticsearch": {"certainty": 0.6, "num_candidates": 10000},
}


def requests_mixed_stores(spark, sf_dir):
    """Six stores' rules over every class query, in one product (C13 with C3-C7)."""
    coll = C.collection(spark, sf_dir)
    requests = with_store_rules(C.class_queries(coll), STORE_REQUESTS)
    h = search_requests(coll, requests, id_col="vec_id")
    return h.select("query_id", "store", "vec_id", F.round("score", R).alias("score"), "rank")


def _manhattan(rows, queries):
    """Sums of absolute differences; one column at a time, so no third dimension is held."""
    return np.stack([np.abs(rows - q).sum(axis=1) for q in queries], axis=1)


def search_registered_metric(spark, sf_dir):
    """H4: a metric and a store from outside the library, over all rows for every hundredth as query."""
    register_metric("manhattan", Metric(_manhattan, higher_is_better=False))
    register_profile(Profile("blocks", ScoreRule("manhattan"), None, K), cutoff_key="reach")
    coll = C.collection(spark, sf_dir)
    queries = coll.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    h = search_request(coll, queries, "blocks", {"reach": REACH}, id_col="vec_id")
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


# -- threshold sweep (D11) ----------------------------------------------------------------


def _scored(spark, sf_dir):
    """Every item scored for every class query, with its truth; scores rounded, so that many tie."""
    coll = C.collection(spark, sf_dir)
    hits = search(coll, C.class_queries(coll), rule=COS, cutoff=-1.0, id_col="vec_id", carry=["label"])
    truth = (F.col("label") == F.col("query_id")).cast("int")
    return hits.select("query_id", F.round("score", 3).alias("score"), truth.alias("y_true"))


def pr_curve(spark, sf_dir):
    """Precision and recall at every score of every class query."""
    t = threshold_sweep(_scored(spark, sf_dir), ["query_id"])
    return t.select("query_id", "threshold", "tp", "fp", "fn", F.round("precision", R).alias("precision"), F.round("recall", R).alias("recall"))


def mean_average_precision_sweep(spark, sf_dir):
    t = mean_average_precision(threshold_sweep(_scored(spark, sf_dir), ["query_id"]), ["query_id"])
    return t.select("n_queries", F.round("mean_average_precision", R).alias("mean_average_precision"))


# -- sketches and as-of joins (E3, E5) ------------------------------------------------------


def latency_sketch_merged(spark, sf_dir):
    """Percentiles from daily sketches, written and merged; whether each lies within 2 % of its rank among all rows."""
    log = C.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    path = scratch_path(spark, "sketches")
    ST.quantile_sketches(log, "value", ["event_type", "day"]).write.parquet(path)
    q = ST.merged_quantiles(spark.read.parquet(path), ["event_type"])
    ranks = log.join(q, "event_type").groupBy("event_type").agg(
        F.first("n").alias("n"), *[(F.count_if(F.col("value") <= F.col(p)) / F.count("value")).alias(p) for p in ("p90", "p95", "p99")]
    )
    near = [F.abs(F.col(p) - int(p[1:]) / 100).alias(p) <= 0.02 for p in ("p90", "p95", "p99")]
    return ranks.select("event_type", "n", (near[0] & near[1] & near[2]).alias("within"))


def memory_by_phase(spark, sf_dir):
    """Memory at the start and the end of each phase: the user's latest sample at or before (E5).

    Samples are the ``view`` events; a phase starts at a ``purchase`` and lasts as many minutes as its value.
    """
    e = C.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), "value")
    samples = e.where("event_type = 'view'").select("user_id", "at", F.col("value").alias("memory"))
    phases = e.where("event_type = 'purchase'")
    ends = phases.select("event_id", "user_id", (F.col("at") + F.floor(F.col("value") * 60e6).cast("long")).alias("at"))
    side = lambda p, name: last_before(samples, p, ["user_id"], "at", ["memory"]).select("event_id", F.col("memory").alias(name))
    first, last = side(phases.select("event_id", "user_id", "at"), "memory_start"), side(ends, "memory_end")
    return first.join(last, "event_id").withColumn("delta", F.round(F.col("memory_end") - F.col("memory_start"), R))


def _codes(spark, coll):
    path = scratch_path(spark, "codes")
    dim = coll.agg(F.max(F.size("embedding"))).first()[0]
    save_codes(build_codes(coll, dim), path)
    return load_codes(spark, path, dim)


def code_filter_search(spark, sf_dir):
    """G4 + C2: exact search at a cut-off by filtering one-byte codes and scoring the survivors."""
    coll = C.collection(spark, sf_dir)
    hits = code_search(_codes(spark, coll), _row_queries(coll), cutoff=NEAR, limit=C.LIMIT, id_col="vec_id")
    return hits.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


def code_filter_bytes(spark, sf_dir):
    """Bytes that a pass over the codes reads, and that a pass over the vectors would."""
    return scanned_bytes(_codes(spark, C.collection(spark, sf_dir)))


QUERIES = {
    "code_filter_search": code_filter_search,
    "code_filter_bytes": code_filter_bytes,
    "pr_curve": pr_curve,
    "mean_average_precision_sweep": mean_average_precision_sweep,
    "latency_sketch_merged": latency_sketch_merged,
    "memory_by_phase": memory_by_phase,
    "ivf_bounded_topk": ivf_bounded_topk,
    "ivf_bounded_cutoff": ivf_bounded_cutoff,
    "lsh_recall": lsh_recall,
    "ivf_recall": ivf_recall,
    "pool_recall": pool_recall,
    "requests_mixed_stores": requests_mixed_stores,
    "search_registered_metric": search_registered_metric,
}

_ROW_HITS = """
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
_RECALL = f"WITH {_ROW_HITS} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_hits, true AS reached FROM ranked WHERE rank <= {K}"

# (store, score of the cosine, cut-off test, limit)
_RULES = [
    ("pgvector", "cos", "cos >= 0.2", 10000),
    ("qdrant", "cos", "cos >= 0.25", 20),
    ("milvus", "cos", "cos >= 0.2", 16000),
    ("weaviate", "(1 + cos) / 2", "(1 + cos) / 2 >= 0.6", 10000),
    ("chroma", "1 - cos", "1 - cos <= 0.75", 50),
    ("elasticsearch", "(1 + cos) / 2", "(1 + cos) / 2 >= 0.6", 10),
]

_SWEEP = "WITH " + PROTOS + """,
scored AS (
  SELECT p.query_id, round(list_cosine_similarity(p.qv, e.embedding::DOUBLE[]), 3) AS score, CAST(e.label = p.query_id AS INT) AS y
  FROM protos p, embeddings e
),
counted AS (SELECT query_id, score AS threshold, sum(y) AS t, count(*) AS n FROM scored GROUP BY ALL),
swept AS (
  SELECT query_id, threshold, t, sum(t) OVER w AS tp, sum(n) OVER w AS n_all, sum(t) OVER (PARTITION BY query_id) AS pos
  FROM counted WINDOW w AS (PARTITION BY query_id ORDER BY threshold DESC)
)"""

ORACLES = {
    "code_filter_search": f"""
WITH {_ROW_HITS}
SELECT query_id, vec_id, round(score, {R}) AS score, rank FROM ranked WHERE score >= {NEAR} AND rank <= {C.LIMIT}""",
    "code_filter_bytes": """
WITH d AS (SELECT max(len(embedding)) AS dim FROM embeddings)
SELECT count(*) AS n_rows, CAST(sum(dim + 16) AS BIGINT) AS code_bytes, CAST(sum(4 * dim) AS BIGINT) AS vector_bytes
FROM embeddings, d
WHERE len(embedding) = dim AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0""",
    "pr_curve": _SWEEP + f"""
SELECT query_id, threshold, CAST(tp AS BIGINT) AS tp, CAST(n_all - tp AS BIGINT) AS fp, CAST(pos - tp AS BIGINT) AS fn,
       round(tp / n_all, {R}) AS precision, round(tp / nullif(pos, 0), {R}) AS recall FROM swept""",
    "mean_average_precision_sweep": _SWEEP + f"""
SELECT count(ap) AS n_queries, round(avg(ap), {R}) AS mean_average_precision
FROM (SELECT query_id, sum(tp / n_all * t) / nullif(max(pos), 0) AS ap FROM swept GROUP BY query_id)""",
    "latency_sketch_merged": "SELECT event_type, count(value) AS n, true AS within FROM events GROUP BY event_type",
    "memory_by_phase": f"""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, value FROM events),
samples AS (SELECT user_id, t, max(value) AS memory FROM e WHERE event_type = 'view' GROUP BY ALL),
phases AS (SELECT event_id, user_id, t, t + CAST(floor(value * 60e6) AS BIGINT) AS stop FROM e WHERE event_type = 'purchase')
SELECT p.event_id, a.memory AS memory_start, b.memory AS memory_end, round(b.memory - a.memory, {R}) AS delta
FROM phases p ASOF LEFT JOIN samples a ON p.user_id = a.user_id AND p.t >= a.t
ASOF LEFT JOIN samples b ON p.user_id = b.user_id AND p.stop >= b.t""",
    "ivf_bounded_topk": f"WITH {_ROW_HITS} SELECT query_id, vec_id, round(score, {R}) AS score, rank FROM ranked WHERE rank <= {K}",
    "ivf_bounded_cutoff": f"WITH {_ROW_HITS} SELECT query_id, vec_id, round(score, {R}) AS score, rank FROM ranked WHERE score >= {C.THRESHOLD} AND rank <= {C.LIMIT}",
    "lsh_recall": _RECALL,
    "ivf_recall": _RECALL,
    "pool_recall": _RECALL,
    "search_registered_metric": f"""
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id,
         list_sum([abs(q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) FOR i IN range(1, len(q.embedding) + 1)]) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0
)
SELECT query_id, vec_id, round(score, {R}) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s WHERE score <= {REACH}
) WHERE rank <= {K}""",
    "requests_mixed_stores": "WITH " + PROTOS + ", c AS (SELECT p.query_id, e.vec_id, list_cosine_similarity(p.qv, e.embedding::DOUBLE[]) AS cos FROM protos p, embeddings e)"
    + " UNION ALL ".join(
        f"""
SELECT query_id, store, vec_id, round(score, {R}) AS score, rank FROM (
  SELECT query_id, '{store}' AS store, vec_id, {score} AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM c WHERE {test}
) WHERE rank <= {limit}"""
        for store, score, test, limit in _RULES
    ),
}
