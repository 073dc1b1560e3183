"""DuckDB SQL equivalents of the registered queries (same column names).

The views ``embeddings documents labels pages events ...`` are registered by
the checker.  Cosine is computed on ``DOUBLE[]`` casts, exactly as the Spark
side does its arithmetic in double.
"""

from __future__ import annotations

from nearfield.functions.text import letter_profile_sql
from nearfield.plans import catalog as C

R = 6

# Class prototypes of the collection.
PROTOS = """
emb_u AS (
  SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x
  FROM embeddings
),
protos AS (
  SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS qv
  FROM (SELECT label, pos, sum(x) AS x FROM emb_u GROUP BY label, pos)
  GROUP BY label
)"""


def scored(expr: str = "list_cosine_similarity(p.qv, e.embedding::DOUBLE[])", where: str = "") -> str:
    return f"""
scored AS (
  SELECT p.query_id, e.vec_id, e.label, {expr} AS score
  FROM protos p, embeddings e {where}
)"""


def ranked(cond: str, order: str = "score DESC", limit: int = C.LIMIT, src: str = "scored") -> str:
    return f"""
hits AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id) AS rank
    FROM {src} WHERE {cond}
  ) WHERE rank <= {limit}
)"""


CLASS_HITS = "WITH " + PROTOS + "," + scored() + "," + ranked(f"score >= {C.THRESHOLD}")

METRICS = """
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_score,
  tn::DOUBLE / nullif(tn + fp, 0) AS specificity,
  fp::DOUBLE / nullif(fp + tn, 0) AS far,
  fn::DOUBLE / nullif(fn + tp, 0) AS frr"""

# Document collection: letter profiles, long labels, target prototypes.
_TARGET_ID = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(C.DOC_TARGETS))
_TARGET_NAME = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(C.DOC_TARGETS))
DOCS = f"""
dvec AS (SELECT doc_id, {letter_profile_sql('text')} AS v FROM documents),
lab AS (
  SELECT doc_id, target, y_true FROM (
    SELECT doc_id, 'quality' AS target, CAST(quality AS INTEGER) AS y_true FROM labels
    UNION ALL
    SELECT doc_id, 'toxic' AS target, CAST(toxic AS INTEGER) AS y_true FROM labels
  )
),
dproto_u AS (
  SELECT l.target, generate_subscripts(d.v, 1) AS pos, unnest(d.v) AS x
  FROM lab l JOIN dvec d USING (doc_id) WHERE l.y_true = 1
),
dprotos AS (
  SELECT CAST(CASE target {_TARGET_ID} END AS BIGINT) AS query_id, list(x ORDER BY pos) AS qv
  FROM (SELECT target, pos, sum(x) AS x FROM dproto_u GROUP BY target, pos) GROUP BY target
),
dscored AS (
  SELECT p.query_id, d.doc_id, list_cosine_similarity(p.qv, d.v) AS score FROM dprotos p, dvec d
),
dhits AS (
  SELECT *, CASE query_id {_TARGET_NAME} END AS target FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM dscored WHERE score >= {C.DOC_THRESHOLD}
  ) WHERE rank <= {C.LIMIT}
)"""


ORACLES: dict[str, str] = {}

ORACLES["flagship_search_eval"] = CLASS_HITS + f""",
sizes AS (
  SELECT CAST(label AS BIGINT) AS query_id, count(*) AS n_pos, sum(count(*)) OVER () AS n_all
  FROM embeddings GROUP BY label
),
per_q AS (
  SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE label = query_id) AS tp
  FROM hits GROUP BY query_id
),
conf AS (
  SELECT s.query_id, CAST(coalesce(q.n_hits, 0) AS BIGINT) AS n_hits,
         CAST(coalesce(q.tp, 0) AS BIGINT) AS tp,
         CAST(coalesce(q.n_hits, 0) - coalesce(q.tp, 0) AS BIGINT) AS fp,
         CAST(s.n_pos - coalesce(q.tp, 0) AS BIGINT) AS fn,
         CAST(s.n_all - s.n_pos - (coalesce(q.n_hits, 0) - coalesce(q.tp, 0)) AS BIGINT) AS tn
  FROM sizes s LEFT JOIN per_q q USING (query_id)
)
SELECT query_id, n_hits, tp, fp, fn, tn, {METRICS} FROM conf"""

ORACLES["exact_threshold_search"] = CLASS_HITS + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM hits"""

ORACLES["batch_knn_topk"] = (
    "WITH " + PROTOS + "," + scored() + "," + ranked("score IS NOT NULL", limit=C.TOPK)
    + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM hits"""
)

ORACLES["batch_knn_many"] = "WITH " + PROTOS.replace("SELECT label, gen", "SELECT label * 25 + vec_id % 25 AS label, gen") + "," + scored() + "," + ranked(
    "score IS NOT NULL"
) + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM hits"""

ORACLES["hits_basename"] = CLASS_HITS + """
SELECT h.query_id, h.vec_id, CAST(h.rank AS BIGINT) AS rank,
       string_split(p.url, '/')[-1] AS base_name
FROM hits h LEFT JOIN pages p ON p.page_id = h.vec_id
WHERE string_split(p.url, '/')[-1] <> ''"""

ORACLES["labelled_hits_semi"] = "WITH " + DOCS + """
SELECT l.doc_id, l.target, l.y_true FROM lab l
WHERE EXISTS (SELECT 1 FROM dhits h WHERE h.target = l.target AND h.doc_id = l.doc_id)"""

ORACLES["labelled_misses_anti"] = "WITH " + DOCS + """
SELECT l.doc_id, l.target, l.y_true FROM lab l
WHERE NOT EXISTS (SELECT 1 FROM dhits h WHERE h.target = l.target AND h.doc_id = l.doc_id)"""

# -- step 2: store profiles --------------------------------------------------------

_COS = "list_cosine_similarity(p.qv, e.embedding::DOUBLE[])"
_OUT = f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM hits"""

ORACLES["search_profile_cosine"] = "WITH " + PROTOS + "," + scored() + "," + ranked("score >= 0.0", limit=1600) + _OUT

ORACLES["search_profile_post_filter"] = (
    "WITH " + PROTOS + "," + scored() + "," + ranked("score IS NOT NULL", limit=50)
    + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank
FROM hits WHERE score >= {C.THRESHOLD}"""
)

ORACLES["search_profile_half_shift"] = (
    "WITH " + PROTOS + "," + scored(f"(1.0 + {_COS}) / 2.0") + "," + ranked("score >= 0.6") + _OUT
)

ORACLES["search_profile_distance"] = (
    "WITH " + PROTOS + "," + scored(f"1.0 - {_COS}") + ","
    + ranked("score <= 0.8", order="score ASC", limit=16000) + _OUT
)

# -- step 3: metrics and pre-filter ------------------------------------------------

ORACLES["metric_inner_product"] = (
    "WITH " + PROTOS + "," + scored("list_inner_product(p.qv, e.embedding::DOUBLE[])") + ","
    + ranked("score IS NOT NULL", limit=C.TOPK) + _OUT
)

ORACLES["metric_l2"] = (
    "WITH " + PROTOS + "," + scored("list_distance(p.qv, e.embedding::DOUBLE[])") + ","
    + ranked("score IS NOT NULL", order="score ASC", limit=C.TOPK) + _OUT
)

ORACLES["prefiltered_search"] = (
    "WITH " + PROTOS + "," + scored(where="WHERE e.label BETWEEN 3 AND 6") + ","
    + ranked(f"score >= {C.THRESHOLD}")
    + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank, label
FROM hits"""
)

# -- step 4: multi-target evaluation ---------------------------------------------

_DOC_PRED = "WITH " + DOCS + """,
pred AS (
  SELECT l.doc_id, l.target, l.y_true,
         CASE WHEN EXISTS (SELECT 1 FROM dhits h WHERE h.target = l.target AND h.doc_id = l.doc_id)
              THEN 1 ELSE 0 END AS y_pred
  FROM lab l
)"""

ORACLES["confusion_multi_target"] = _DOC_PRED + f""",
conf AS (
  SELECT target,
    CAST(count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS BIGINT) AS fn,
    CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS BIGINT) AS tp
  FROM pred GROUP BY target
)
SELECT target, tn, fp, fn, tp, {METRICS} FROM conf"""

ORACLES["degenerate_class_flags"] = _DOC_PRED + """
SELECT target, CAST(count(*) AS BIGINT) AS n_labelled, CAST(sum(y_true) AS BIGINT) AS n_true,
       CAST(sum(y_pred) AS BIGINT) AS n_pred,
       (min(y_true) = max(y_true) AND min(y_pred) = max(y_pred) AND min(y_true) = min(y_pred))
         AS is_degenerate
FROM (SELECT target, y_true, y_pred FROM pred UNION ALL SELECT 'unsought', 0, 0 FROM labels) GROUP BY target"""

ORACLES["average_precision"] = CLASS_HITS + f""",
rel AS (
  SELECT query_id, rank, CASE WHEN label = query_id THEN 1 ELSE 0 END AS rel FROM hits
),
cum AS (
  SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM rel
),
s AS (
  SELECT query_id, sum(CASE WHEN rel = 1 THEN c::DOUBLE / rank::DOUBLE ELSE 0.0 END) AS s
  FROM cum GROUP BY query_id
),
pos AS (SELECT CAST(label AS BIGINT) AS query_id, count(*) AS n_pos FROM embeddings GROUP BY label)
SELECT p.query_id, CAST(p.n_pos AS BIGINT) AS n_pos,
       round(coalesce(s.s, 0.0) / p.n_pos::DOUBLE, {R}) AS average_precision
FROM pos p LEFT JOIN s USING (query_id)"""

_QUALITY = ("precision", "recall", "f1_score", "specificity", "far", "frr")
_MEANS = ", ".join(f"round(avg({m}), {R}) AS {m}" for m in _QUALITY)


def _quality_of(store: str, dataset: str, metrics_sql: str) -> str:
    return (
        f"SELECT '{store}' AS database, '{dataset}' AS dataset, CAST(count(*) AS BIGINT) AS n_queries, {_MEANS} "
        f"FROM ({metrics_sql})"
    )


def _limited(sql: str, limit: int) -> str:
    return sql.replace(f"rank <= {C.LIMIT}", f"rank <= {limit}")


ORACLES["report_quality"] = "\nUNION ALL\n".join(
    _quality_of(store, dataset, _limited(ORACLES[name], limit))
    for store, limit in (("PGVECTOR", C.LIMIT), ("MILVUS", 50))
    for dataset, name in (("embeddings", "flagship_search_eval"), ("documents", "confusion_multi_target"))
)

# -- step 5/6: request-log statistics -----------------------------------------------

_WIDE = """
w AS (
  SELECT event_type, CAST(count(value) AS BIGINT) AS n, avg(value) AS mean,
         stddev_pop(value) AS std, quantile_cont(value, 0.90) AS p90,
         quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
  FROM events WHERE event_type <> 'error' GROUP BY event_type
)"""

ORACLES["latency_summary_wide"] = "WITH " + _WIDE + f"""
SELECT event_type, n, round(mean, {R}) AS mean, round(std, {R}) AS std, round(p90, {R}) AS p90,
       round(p95, {R}) AS p95, round(p99, {R}) AS p99
FROM w"""

ORACLES["latency_summary_long"] = "WITH " + _WIDE + "\n" + "\nUNION ALL\n".join(
    f"SELECT event_type, '{m}' AS metric, round(CAST({m} AS DOUBLE), {R}) AS value FROM w"
    for m in ("n", "mean", "std", "p90", "p95", "p99")
)

ORACLES["stats_null_group"] = f"""
WITH e AS (SELECT *, nullif(event_type, 'error') AS store FROM events),
it AS (SELECT store, event_type, row_number() OVER (PARTITION BY store ORDER BY ts, event_id) AS iteration FROM e),
last AS (SELECT store, max(iteration) FILTER (WHERE event_type <> 'error') AS last_iteration FROM it GROUP BY store),
w AS (
  SELECT store, CAST(count(value) AS BIGINT) AS n, round(avg(value), {R}) AS mean, round(stddev_pop(value), {R}) AS std,
         round(quantile_cont(value, 0.90), {R}) AS p90, round(quantile_cont(value, 0.95), {R}) AS p95,
         round(quantile_cont(value, 0.99), {R}) AS p99
  FROM e GROUP BY store
)
SELECT p.path, w.*, CAST(l.last_iteration AS BIGINT) AS last_iteration
FROM w LEFT JOIN last l ON w.store IS NOT DISTINCT FROM l.store, (VALUES ('window'), ('range')) p(path)"""

ORACLES["throughput_by_store"] = f"""
WITH t AS (
  SELECT event_type, CAST(count(*) AS BIGINT) AS total_requests,
         CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS successful_requests,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS elapsed_s
  FROM events GROUP BY event_type
)
SELECT event_type, total_requests, successful_requests, round(elapsed_s, {R}) AS elapsed_s,
       round(CASE WHEN elapsed_s > 0 THEN successful_requests / elapsed_s ELSE 0.0 END, {R}) AS rps
FROM t"""

ORACLES["iteration_numbering"] = """
SELECT run_day, event_id, iteration FROM (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_day, event_id, event_type,
         CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT)
           AS iteration
  FROM events
) WHERE event_type <> 'error'"""

ORACLES["phase_durations"] = f"""
SELECT user_id, strftime(min(ts), '%Y-%m-%d_%H-%M-%S') AS start_text,
       strftime(max(ts), '%Y-%m-%d_%H-%M-%S') AS end_text, CAST(count(*) AS BIGINT) AS n_events,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, {R}) AS duration_s
FROM events GROUP BY user_id"""

ORACLES["memory_delta"] = f"""
SELECT user_id, event_id,
       round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), {R}) AS delta
FROM events"""
