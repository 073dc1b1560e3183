"""Exact vector search as a Spark plan.

``search(collection, queries, ...)`` scores every collection row against every
query, keeps the rows that pass the cut-off of the score rule, and (with a
limit) the best ``limit`` rows per query, ordered by ``(score, id)``.

Plan shape (method ``"arrow"``, the default)::

    scan(collection) -> [prefilter] -> mapInArrow(GEMM vs broadcast queries)
      -> partial top-k per map partition -> shuffle(query_id) -> final top-k

The collection is never shuffled; only hits move.  The query matrix is the
broadcast side: its size is measured first, and a query set over the budget is
read in blocks of bounded size, one after another, each block one streamed pass
over the collection.  A block also holds no more queries than the per-task
top-k has room for.  Queries of another length than a row never hit it.

Method ``"sql"`` is the same search written with higher-order functions and a
broadcast nested-loop join; it is the pure-SQL baseline used in tests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import vectors as V
from nearfield.functions.scalars import base_name, non_empty
from nearfield.operators.scoring import BUILT_IN_METRICS, PARTITION_TOPK_ROWS, make_batch_scorer, registered_metric

# Largest query matrix broadcast to the scorer in one pass (bytes of float64).
DEFAULT_QUERY_BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class ScoreRule:
    """How a store turns cosine into the number its cut-off applies to.

    ``metric``: ``cosine`` | ``ip`` (inner product) | ``l2`` (Euclidean), or the
    name of a metric given to ``scoring.register_metric``.
    ``transform`` on the metric value: ``identity`` | ``half_shift``
    (``(1 + s) / 2``) | ``distance`` (``1 - s``).
    """

    metric: str = "cosine"
    transform: str = "identity"

    def __post_init__(self):
        if self.metric not in BUILT_IN_METRICS and registered_metric(self.metric) is None:
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.transform not in ("identity", "half_shift", "distance"):
            raise ValueError(f"unknown transform {self.transform!r}")

    @property
    def higher_is_better(self) -> bool:
        outside = registered_metric(self.metric)
        if outside is not None:
            return outside.higher_is_better != (self.transform == "distance")
        return self.metric != "l2" and self.transform != "distance"

    def cosine_cutoff(self, cutoff: float) -> float:
        """The equivalent cut-off on raw cosine (for comparing profiles)."""
        if self.metric != "cosine":
            raise ValueError("only cosine rules reduce to a cosine cut-off")
        return {"identity": cutoff, "half_shift": 2 * cutoff - 1, "distance": 1 - cutoff}[
            self.transform
        ]


@dataclass(frozen=True)
class Profile:
    """Search parameters of one store's request shape (C14 defaults)."""

    name: str
    rule: ScoreRule
    cutoff: float | None
    limit: int | None
    post_filter: bool = False
    required: tuple[str, ...] = ()


# Per-store defaults of the request shapes.
_PROFILES = {
    "pgvector": Profile("pgvector", ScoreRule("cosine", "identity"), 0.0, 1600),
    "qdrant": Profile("qdrant", ScoreRule("cosine", "identity"), 0.0, 1600),
    "milvus": Profile("milvus", ScoreRule("cosine", "identity"), 0.5, 16000, post_filter=True),
    "weaviate": Profile(
        "weaviate", ScoreRule("cosine", "half_shift"), None, None, required=("cutoff", "limit")
    ),
    "chroma": Profile("chroma", ScoreRule("cosine", "distance"), 0.5, 16000, post_filter=True),
    "elasticsearch": Profile("elasticsearch", ScoreRule("cosine", "half_shift"), 0.5, 10),
}


def profile(name: str, **overrides) -> Profile:
    """Look up a store profile by name; unknown names raise ``ValueError`` (H4)."""
    key = name.lower()
    if key not in _PROFILES:
        raise ValueError(f"Unsupported vector database: {name}")
    p = replace(_PROFILES[key], **overrides)
    missing = [k for k in p.required if getattr(p, k) is None]
    if missing:
        raise KeyError(f"profile {name!r} needs {missing}")
    return p


def register_profile(prof: Profile, cutoff_key: str = "certainty") -> None:
    """Make a store of one's own known to ``profile`` and to requests (H4)."""
    if prof.name.lower() in _CUTOFF_KEY:
        raise ValueError(f"{prof.name!r} is a built-in profile")
    _PROFILES[prof.name.lower()] = prof
    _OWN_CUTOFF_KEY[prof.name.lower()] = cutoff_key


def profile_names() -> list[str]:
    return sorted(_PROFILES)


# ----------------------------------------------------------------------------
# query matrix


def _query_block_arrays(rows, metric: str):
    """Rows of (query_id, vector) -> [(ids int64[q], Q float64[q, d])], one per vector length."""
    by_length: dict[int, tuple[list, list]] = {}
    for qid, vec in rows:
        if vec is None or any(x is None for x in vec):
            continue
        arr = np.asarray(vec, dtype=np.float64)
        if not np.all(np.isfinite(arr)):
            continue
        if metric == "cosine" and not np.any(arr):
            continue
        ids, vecs = by_length.setdefault(len(arr), ([], []))
        ids.append(int(qid))
        vecs.append(arr)
    return [(np.asarray(ids, np.int64), np.vstack(vecs)) for _, (ids, vecs) in sorted(by_length.items())]


def _query_size(queries: DataFrame, qvec: str) -> tuple[int, int]:
    """Row count and largest vector length of a query set (one small job)."""
    st = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("d")).first()
    return int(st["n"] or 0), max(int(st["d"] or 0), 0)


def query_slices(rows, max_rows: int):
    """Lists of at most ``max_rows`` rows; only the current one is held."""
    block = []
    for row in rows:
        block.append(row)
        if len(block) == max_rows:
            yield block
            block = []
    if block:
        yield block


def _block_rows(dim: int, budget_bytes: int, limit: int | None) -> int:
    """Queries of one block: its matrix fits the budget, its top-k the per-task state."""
    rows = max(1, budget_bytes // (max(dim, 1) * 8))
    return min(rows, max(1, PARTITION_TOPK_ROWS // limit)) if limit else rows


def _query_blocks(queries: DataFrame, qid: str, qvec: str, budget_bytes: int, limit: int | None):
    """Yield the query set in bounded blocks.

    The size is measured first (one small aggregate job); a query set that fits
    is collected at once, a larger one is streamed partition by partition.
    """
    qv = F.col(qvec)
    if isinstance(queries.schema[qvec].dataType, T.BinaryType):  # packed float32
        qv = V.unpack_f32(qv)
    q = queries.select(F.col(qid).cast("long").alias("qid"), V.as_double(qv).alias("v"))
    n, d = _query_size(q, "v")
    total = n * max(d, 1) * 8
    if total <= budget_bytes:
        rows = q.collect()
    else:
        rows = q.repartition(2 * math.ceil(total / budget_bytes)).toLocalIterator()
    yield from query_slices(rows, _block_rows(d, budget_bytes, limit))


# ----------------------------------------------------------------------------
# search


def _order_cols(rule: ScoreRule, id_col: str):
    s = F.col("score").desc() if rule.higher_is_better else F.col("score").asc()
    return [s, F.col(id_col).asc()]


# Tree reduction of per-query top-k: at most this many candidate rows per
# query may reach one task; above it, intermediate top-k levels each merge
# FAN_IN groups of map partitions.
MAX_TOPK_ROWS_PER_TASK = 2_000_000
TOPK_FAN_IN = 64


def estimated_scan_tasks(df: DataFrame) -> int:
    """Map tasks of a scan, from Catalyst's size estimate (no job is run)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_task = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(1, math.ceil(size / max(per_task, 1)))


def topk_levels(map_tasks: int, limit: int, max_rows: int = MAX_TOPK_ROWS_PER_TASK,
                fan_in: int = TOPK_FAN_IN) -> int:
    """Intermediate top-k levels so no task merges more than ``max_rows`` per query."""
    levels, groups = 0, max(int(map_tasks), 1)
    while groups > 1 and groups * limit > max_rows:
        groups = math.ceil(groups / fan_in)
        levels += 1
    return levels


def top_per_query(
    hits: DataFrame, rule: ScoreRule, limit: int, id_col: str, levels: int = 0,
    fan_in: int = TOPK_FAN_IN,
) -> DataFrame:
    """Best ``limit`` rows per query by ``(score, id)``, with a ``rank`` column.

    Each map task already holds at most ``limit`` rows per query (the scorer
    keeps a running top-k).  With ``levels > 0``, rows are first reduced per
    (query, group of ``fan_in ** l`` map partitions), level by level, so a
    query over a huge collection never sends ``tasks x limit`` rows to one
    task.  ``row_number() <= k`` is a partial top-k before each shuffle when
    ``k`` is within Spark's window-group-limit threshold.
    """
    order = _order_cols(rule, id_col)
    if levels > 0:
        cur = hits.withColumn("__b", F.spark_partition_id().cast("long"))
        for lvl in range(1, levels + 1):
            grp = F.floor(F.col("__b") / F.lit(fan_in**lvl))
            w = Window.partitionBy("query_id", grp).orderBy(*order)
            cur = cur.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")
        hits = cur.drop("__b")
    w = Window.partitionBy("query_id").orderBy(*order)
    return (
        hits.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= F.lit(int(limit)))
        .withColumn("rank", F.col("rank").cast("long"))
    )


def _sql_score(rule: ScoreRule, v, q):
    if rule.metric == "cosine":
        raw = V.cosine(v, q)
    elif rule.metric == "ip":
        raw = V.inner_product(v, q)
    elif rule.metric == "l2":
        raw = V.l2_distance(v, q)
    else:
        column = registered_metric(rule.metric).column
        if column is None:
            raise ValueError(f"metric {rule.metric!r} has no Column form")
        raw = F.when(F.size(v) == F.size(q), column(v, q))
    if rule.transform == "half_shift":
        return (F.lit(1.0) + raw) / F.lit(2.0)
    if rule.transform == "distance":
        return F.lit(1.0) - raw
    return raw


def search(
    collection: DataFrame,
    queries,
    *,
    rule: ScoreRule = ScoreRule(),
    cutoff: float | None = None,
    limit: int | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "embedding",
    prefilter: str | None = None,
    carry: tuple[str, ...] | list[str] = (),
    method: str = "arrow",
    budget_bytes: int = DEFAULT_QUERY_BROADCAST_BYTES,
    probe_fn=None,
    cell_col: str | None = None,
) -> DataFrame:
    """Exact search of ``queries`` against ``collection``.

    ``queries`` is a DataFrame (``query_id``, vector) or in-memory vectors
    (``{query_id: vector}`` or a list, ids 0..n-1), like one store request.

    Returns ``query_id, <id_col>, score[, rank], *carry``; ``score`` is the
    native score of ``rule``.  The cut-off is inclusive (``>=``, or ``<=`` for
    distances).  ``prefilter`` is a SQL predicate on collection columns applied
    before scoring (pushed to the scan when it is on stored columns).  One of
    ``cutoff`` and ``limit`` is required: without both, every pair is a hit.
    """
    if cutoff is None and limit is None:
        raise ValueError("a search needs a cutoff or a limit")
    carry = tuple(c for c in carry if c not in (id_col,))
    scan_cols = (id_col, vec_col, *carry) + ((cell_col,) if cell_col and cell_col not in carry else ())
    if limit is not None and int(limit) <= 0:
        limit = 0
    coll = collection
    if prefilter:
        coll = coll.where(F.expr(prefilter))
    coll = coll.select(*scan_cols)
    if limit == 0:
        coll = coll.where(F.lit(False))

    local_rows = None
    if not isinstance(queries, DataFrame):
        # In-memory query vectors ({query_id: vector} or a sequence of vectors),
        # as a request to a store carries them: no job is needed to fetch them.
        items = queries.items() if isinstance(queries, dict) else enumerate(queries)
        local_rows = [(int(k), None if v is None else [float(x) for x in v]) for k, v in items]
        if method != "arrow":
            queries = coll.sparkSession.createDataFrame(
                local_rows, f"{query_id_col} long, {query_vec_col} array<double>"
            )

    if method == "arrow":
        fields = {f.name: f for f in coll.schema.fields}
        out_schema = T.StructType(
            [
                T.StructField("query_id", T.LongType(), False),
                T.StructField(id_col, fields[id_col].dataType, True),
                T.StructField("score", T.DoubleType(), True),
                *[T.StructField(c, fields[c].dataType, True) for c in carry],
            ]
        )
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_schema = to_arrow_schema(out_schema)
        sc = coll.sparkSession.sparkContext
        parts = []
        if local_rows is not None:
            dim = max((len(v or ()) for _, v in local_rows), default=0)
            blocks = query_slices(local_rows, _block_rows(dim, budget_bytes, limit))
        else:
            blocks = _query_blocks(queries, query_id_col, query_vec_col, budget_bytes, limit)
        for ids, Q in (b for rows in blocks for b in _query_block_arrays(rows, rule.metric)):
            part = coll
            if probe_fn is not None:
                # Cells probed by this block: prune the scan, mask the pairs.
                probes = probe_fn(Q)
                part = coll.where(F.col(cell_col).isin(sorted(probes)))
                bq = sc.broadcast((ids, Q, probes))
            else:
                bq = sc.broadcast((ids, Q))
            fn = make_batch_scorer(
                bq,
                metric=rule.metric,
                transform=rule.transform,
                higher_is_better=rule.higher_is_better,
                cutoff=cutoff,
                cap=limit or None,
                id_col=id_col,
                vec_col=vec_col,
                carry=carry,
                out_schema=arrow_schema,
                cell_col=cell_col,
            )
            parts.append(part.mapInArrow(fn, out_schema))
        if not parts:
            hits = coll.sparkSession.createDataFrame([], out_schema)
        else:
            hits = parts[0]
            for p in parts[1:]:
                hits = hits.unionByName(p)
    elif method == "sql":
        if isinstance(coll.schema[vec_col].dataType, T.BinaryType):
            raise ValueError("packed vectors are scored by method='arrow'")
        n, d = _query_size(queries, query_vec_col)
        if n * max(d, 1) * 8 > budget_bytes:
            raise ValueError("query set over the broadcast budget; use method='arrow'")
        q = queries.select(
            F.col(query_id_col).cast("long").alias("query_id"),
            F.col(query_vec_col).alias("__q"),
        )
        hits = coll.join(F.broadcast(q), how="inner").select(
            "query_id",
            id_col,
            _sql_score(rule, F.col(vec_col), F.col("__q")).alias("score"),
            *carry,
        )
        hits = hits.where(F.col("score").isNotNull())
        if cutoff is not None:
            c = F.lit(float(cutoff))
            hits = hits.where(F.col("score") >= c if rule.higher_is_better else F.col("score") <= c)
    else:
        raise ValueError(f"unknown method {method!r}")

    if limit is not None:
        levels = topk_levels(estimated_scan_tasks(collection), max(int(limit), 1))
        hits = top_per_query(hits, rule, limit, id_col, levels=levels)
        return hits.select("query_id", id_col, "score", "rank", *carry)
    return hits.select("query_id", id_col, "score", *carry)


def search_profile(collection: DataFrame, queries: DataFrame, prof: Profile, **kw) -> DataFrame:
    """Search with a store profile's rule, cut-off and limit.

    ``post_filter`` profiles (top-k first, cut-off second) give the same rows
    as filter-first in exact search, because the cut-off is monotone in the
    sort key; the cheaper filter-first plan is used.
    """
    return search(collection, queries, rule=prof.rule, cutoff=prof.cutoff, limit=prof.limit, **kw)


# Parameter names of the store request dicts.
_CUTOFF_KEY = {
    "pgvector": "certainty",
    "qdrant": "certainty",
    "milvus": "threshold",
    "weaviate": "certainty",
    "chroma": "threshold",
    "elasticsearch": "certainty",
}
_REQUEST_KEYS = {
    "anns_field", "certainty", "expr", "index_params", "limit", "metric_type", "nprobe", "num_candidates", "output_fields", "threshold",
}
_METRICS = {"COSINE": "cosine", "IP": "ip", "L2": "l2"}
# Cut-off keys of registered profiles.
_OWN_CUTOFF_KEY: dict[str, str] = {}


def _metric_named(name: str) -> str:
    if name.upper() in _METRICS:
        return _METRICS[name.upper()]
    if registered_metric(name.lower()) is None:
        raise KeyError(name)
    return name.lower()


@dataclass(frozen=True)
class Request:
    """A store request with its defaults filled in."""

    rule: ScoreRule
    cutoff: float | None
    limit: int | None
    vec_col: str
    prefilter: str | None
    carry: tuple[str, ...]
    candidates: int | None  # pool of an index search
    nprobe: int | None


def resolve_request(store: str, params: dict | None = None, *, id_col: str = "id", vec_col: str = "embedding") -> Request:
    """A request in a store's own keys, as rule, cut-off, limit and columns.

    Missing keys, and keys given as None, take the store's defaults.  ``id``
    among the output fields is the collection's id column.
    """
    params = {k: v for k, v in (params or {}).items() if v is not None}
    unknown = sorted(set(params) - _REQUEST_KEYS - {_OWN_CUTOFF_KEY.get(store.lower())})
    if unknown:
        raise KeyError(f"unknown request keys {unknown}")
    key = store.lower()
    base = profile(key) if key != "weaviate" else _PROFILES["weaviate"]
    cutoff = params.get(_CUTOFF_KEY.get(key) or _OWN_CUTOFF_KEY.get(key, "certainty"), base.cutoff)
    limit = params.get("limit", base.limit)
    if key == "weaviate" and (cutoff is None or limit is None):
        raise KeyError("weaviate requests need 'certainty' and 'limit'")
    rule = base.rule
    if "metric_type" in params:
        rule = ScoreRule(_metric_named(str(params["metric_type"])), rule.transform)
    # The store's graph parameter: how many candidates a search holds, 64 unless given.
    graph = params.get("index_params", {}).get("ef")
    pool = params.get("num_candidates", graph)
    return Request(
        rule,
        cutoff,
        limit,
        params["anns_field"] if key == "milvus" else params.get("anns_field", vec_col),  # mandatory in that store
        params.get("expr"),
        tuple(c for c in params.get("output_fields", ()) if c not in ("id", id_col)),
        int(pool) if pool is not None else None,
        params.get("nprobe"),
    )


def search_request(
    collection: DataFrame,
    queries,
    store: str,
    params: dict | None = None,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    index=None,
    **kw,
) -> DataFrame:
    """One search request in a store's parameter vocabulary.

    ``params`` uses the store's keys: ``certainty`` or ``threshold`` (cut-off),
    ``limit``, ``metric_type`` (``COSINE``/``IP``/``L2``), ``expr`` (scalar
    pre-filter), ``output_fields`` (carried columns), ``index_params`` and
    ``anns_field`` (vector column; mandatory where the store requires it).
    Missing keys take the store's defaults; unknown stores raise
    ``ValueError``.  With an IVF ``index`` the request is approximate:
    ``num_candidates`` or ``index_params.ef`` (default 100, as the k-NN store)
    sets the candidate pool, or ``nprobe`` the cells; without one it is exact.
    """
    r = resolve_request(store, params, id_col=id_col, vec_col=vec_col)
    common = {
        "rule": r.rule, "cutoff": r.cutoff, "limit": r.limit, "id_col": id_col, "vec_col": r.vec_col,
        "prefilter": r.prefilter, "carry": r.carry, **kw,
    }
    if index is not None:
        from nearfield.operators.ann import ivf_search

        pool = 100 if r.candidates is None and r.nprobe is None else r.candidates
        return ivf_search(index, queries, r.nprobe, num_candidates=pool, **common)
    return search(collection, queries, **common)


REQUEST_FIELDS = "query_id long, store string, embedding array<double>, metric string, transform string, cutoff double, max_hits int"


def requests_table(spark, requests) -> DataFrame:
    """Requests (query_id, vector, store, params) as rows for ``search_requests``."""
    rows = []
    for qid, vector, store, params in requests:
        r = resolve_request(store, params)
        rows.append((int(qid), store.lower(), [float(x) for x in vector], r.rule.metric, r.rule.transform, r.cutoff, r.limit))
    return spark.createDataFrame(rows, REQUEST_FIELDS)


def with_store_rules(queries: DataFrame, params: dict[str, dict]) -> DataFrame:
    """Every query under every store of ``params`` (store -> request keys), as rows for ``search_requests``."""
    rules = []
    for store, own in params.items():
        r = resolve_request(store, own)
        rules.append((store.lower(), r.rule.metric, r.rule.transform, r.cutoff, r.limit))
    if not rules:
        raise ValueError("no requests")
    kinds = {"store": "string", "metric": "string", "transform": "string", "cutoff": "double", "max_hits": "int"}
    items = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, kinds.items())]) for r in rules])
    return queries.select("query_id", "embedding", F.explode(items).alias("r")).select("query_id", "embedding", "r.*")


def search_requests(
    collection: DataFrame,
    requests: DataFrame,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    carry: tuple[str, ...] | list[str] = (),
    budget_bytes: int = DEFAULT_QUERY_BROADCAST_BYTES,
) -> DataFrame:
    """Many requests under many rules, one matrix product per batch of the collection (C13 with C3-C7, C10).

    ``requests``: (query_id, store, embedding, metric, transform, cutoff,
    max_hits), one row per request; cut-off or ``max_hits`` may be null, not
    both.  Returns query_id, store, id, score (native to the rule), rank.
    Requests are read in blocks whose matrix and running top hits are bounded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from nearfield.operators.scoring import make_mixed_scorer

    carry = tuple(c for c in carry if c != id_col)
    coll = collection.select(id_col, vec_col, *carry)
    fields = {f.name: f for f in coll.schema.fields}
    out_schema = T.StructType(
        [
            T.StructField("query_id", T.LongType(), False),
            T.StructField("store", T.StringType(), True),
            T.StructField(id_col, fields[id_col].dataType, True),
            T.StructField("score", T.DoubleType(), True),
            T.StructField("__key", T.DoubleType(), True),
            T.StructField("__most", T.IntegerType(), True),
            *[T.StructField(c, fields[c].dataType, True) for c in carry],
        ]
    )
    if not requests.where("cutoff IS NULL AND max_hits IS NULL").isEmpty():
        raise ValueError("a request needs a cutoff or a limit")
    size = requests.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"), F.max("max_hits").alias("k")).first()
    n, d = int(size["n"] or 0), max(int(size["d"] or 0), 0)
    block = _block_rows(d, budget_bytes, int(size["k"]) if size["k"] else None)
    rows = requests.select("query_id", "store", "embedding", "metric", "transform", "cutoff", "max_hits")
    rows = rows.collect() if n <= block else rows.repartition(2 * math.ceil(n / block)).toLocalIterator()
    sc = coll.sparkSession.sparkContext
    arrow_schema = to_arrow_schema(out_schema)
    parts = []
    for own in query_slices(rows, block):
        by_length: dict[int, list] = {}
        for r in own:
            v = r["embedding"]
            if v is None or any(x is None for x in v) or not np.all(np.isfinite(v)) or (r["metric"] == "cosine" and not np.any(v)):
                continue
            ScoreRule(r["metric"], r["transform"])  # unknown rules raise
            if r["metric"] not in BUILT_IN_METRICS:
                raise ValueError(f"metric {r['metric']!r} shares no product with others: use search() for it")
            by_length.setdefault(len(v), []).append(r)
        for same in by_length.values():
            bq = sc.broadcast([r.asDict() for r in same])
            parts.append(coll.mapInArrow(make_mixed_scorer(bq, id_col, vec_col, carry, arrow_schema), out_schema))
    hits = coll.sparkSession.createDataFrame([], out_schema)
    for p in parts:
        hits = hits.unionByName(p)
    # Each task holds at most a request's limit of rows; they meet in salted parts first.
    order = [F.desc("__key"), F.asc(id_col)]
    salt = F.pmod(F.xxhash64(id_col), F.lit(32))
    least = F.coalesce("__most", F.lit((1 << 31) - 1))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "store", salt).orderBy(*order))).where(F.col("rank") <= least)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "store").orderBy(*order)).cast("long")).where(F.col("rank") <= least)
    return hits.select("query_id", "store", id_col, "score", "rank", *carry)


def hits_to_names(hits: DataFrame, path_col: str, drop_empty: bool = True, unique: bool = False):
    """Hit rows -> base names of their paths, score order kept.

    Duplicates are kept unless ``unique`` (the source documents uniqueness but
    does not do it); ``drop_empty`` removes NULL and empty names.
    """
    out = hits.withColumn("base_name", base_name(path_col))
    if drop_empty:
        out = out.where(non_empty("base_name"))
    if unique:
        out = out.dropDuplicates(["query_id", "base_name"])
    return out


def class_prototypes(df: DataFrame, class_col: str, vec_col: str = "embedding") -> DataFrame:
    """Element-wise sum of the vectors of each class, as ``array<double>``.

    ``Summarizer.sum`` over ML vectors is a JVM partial aggregate: each task
    ships one running sum per class, whatever the row count (about 30x faster
    than exploding vectors into (position, value) rows).  Cosine ignores the
    scale, so the sum serves as the class's query vector.  NULL vectors are
    skipped; all vectors must have the same length.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vec_col).isNotNull()).select(
        class_col, array_to_vector(V.as_double(vec_col)).alias("__v")
    )
    return rows.groupBy(class_col).agg(
        vector_to_array(Summarizer.sum(F.col("__v"))).alias(vec_col)
    )
