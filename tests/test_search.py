"""Search edge rules (FIXTURES §3: vectors, threshold, limits) and scorer parity."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators.search import ScoreRule, profile, profile_names, search

SCHEMA = "id long, embedding array<float>"


def _coll(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _q(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


EDGE = [
    (1, [1.0, 0.0, 0.0]),
    (2, [0.0, 0.0, 0.0]),  # zero vector
    (3, None),  # NULL vector
    (4, [1.0, 0.0]),  # wrong length
    (5, [1.0, None, 0.0]),  # NULL element
    (6, [float("nan"), 1.0, 0.0]),  # NaN element
    (7, [0.6, 0.8, 0.0]),
    (8, [0.6, 0.8, 0.0]),  # identical to 7
]


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_bad_vectors_are_never_hits(spark, method):
    hits = search(_coll(spark, EDGE), _q(spark, [(0, [1.0, 0.0, 0.0])]), cutoff=-1.0, method=method)
    ids = sorted(r.id for r in hits.collect())
    assert ids == [1, 7, 8]


def test_cosine_column_nulls(spark):
    df = _coll(spark, EDGE).select("id", V.cosine("embedding", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("s"))
    got = {r.id: r.s for r in df.collect()}
    assert got[1] == pytest.approx(1.0)
    for i in (2, 3, 4, 5, 6):
        assert got[i] is None


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_threshold_is_inclusive(spark, method):
    coll = _coll(spark, [(7, [0.6, 0.8])])
    q = _q(spark, [(0, [1.0, 0.0])])
    assert search(coll, q, cutoff=0.6, method=method).count() == 1
    dist = ScoreRule("cosine", "distance")
    assert search(coll, q, rule=dist, cutoff=0.4, method=method).count() == 1


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_ties_lower_id_first_and_limits(spark, method):
    coll = _coll(spark, EDGE)
    q = _q(spark, [(0, [0.6, 0.8, 0.0])])
    top1 = search(coll, q, limit=1, method=method).collect()
    assert [r.id for r in top1] == [7]
    assert search(coll, q, limit=0, method=method).count() == 0
    everything = search(coll, q, limit=100, method=method).orderBy("rank").collect()
    assert [r.id for r in everything] == [7, 8, 1]
    assert [r.rank for r in everything] == [1, 2, 3]


def test_arrow_equals_sql_on_table(spark):
    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )
    q = coll.where("label = 3").select(F.col("id").alias("query_id"), "embedding")
    for rule in (ScoreRule(), ScoreRule("ip"), ScoreRule("l2"), ScoreRule("cosine", "half_shift")):
        a = {(r.query_id, r.id): r.score for r in search(coll, q, rule=rule, limit=7).collect()}
        b = {(r.query_id, r.id): r.score for r in search(coll, q, rule=rule, limit=7, method="sql").collect()}
        assert a.keys() == b.keys()
        assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in a)


def test_filter_then_limit_equals_limit_then_filter(spark):
    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    q = coll.limit(5).select(F.col("id").alias("query_id"), "embedding")
    first = search(coll, q, cutoff=0.1, limit=20)
    later = search(coll, q, limit=20).where("score >= 0.1")
    assert sorted(first.select("query_id", "id").collect()) == sorted(later.select("query_id", "id").collect())


def test_profiles_reduce_to_one_cosine_cut():
    assert ScoreRule("cosine", "half_shift").cosine_cutoff(0.6) == pytest.approx(0.2)
    assert ScoreRule("cosine", "distance").cosine_cutoff(0.8) == pytest.approx(0.2)
    assert ScoreRule().cosine_cutoff(0.2) == 0.2


def test_profile_registry():
    assert set(profile_names()) == {"chroma", "elasticsearch", "milvus", "pgvector", "qdrant", "weaviate"}
    with pytest.raises(ValueError):
        profile("nosuchstore")
    with pytest.raises(KeyError):
        profile("weaviate")
    assert profile("weaviate", cutoff=0.6, limit=5).limit == 5


def test_query_blocks_over_budget(spark):
    """A query set over the broadcast budget is split into blocks; same result."""
    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    q = coll.select(F.col("id").alias("query_id"), "embedding")
    small = search(coll, q, cutoff=0.3, budget_bytes=64 * 8 * 40)
    big = search(coll, q, cutoff=0.3)
    key = lambda df: sorted((r.query_id, r.id) for r in df.collect())
    assert key(small) == key(big)


def test_tree_topk_levels_equal_plain(spark):
    from nearfield.operators.search import top_per_query, topk_levels

    assert topk_levels(1, 10_000) == 0
    # 100 TB of 128 MB splits: 800k tasks -> 12,500 -> 196 groups of 64;
    # the final task then merges 196 x 10,000 <= 2M rows per query.
    assert topk_levels(800_000, 10_000) == 2
    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    ).repartition(16)
    q = coll.limit(6).select(F.col("id").alias("query_id"), "embedding")
    raw = search(coll, q, cutoff=-1.0).cache()
    plain = top_per_query(raw, ScoreRule(), 7, "id")
    tree = top_per_query(raw, ScoreRule(), 7, "id", levels=2, fan_in=4)
    key = lambda df: sorted((r.query_id, r.id, r.rank) for r in df.collect())
    assert key(plain) == key(tree)


def test_in_memory_queries_equal_dataframe(spark):
    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    rows = coll.where("id < 3").collect()
    local = {r.id: list(r.embedding) for r in rows}
    q = coll.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    for method in ("arrow", "sql"):
        a = sorted((r.query_id, r.id) for r in search(coll, q, cutoff=0.2, limit=9, method=method).collect())
        b = sorted((r.query_id, r.id) for r in search(coll, local, cutoff=0.2, limit=9, method=method).collect())
        assert a == b and a
    with pytest.raises(ValueError):
        search(coll, local, budget_bytes=8)


def test_search_request_params(spark):
    from nearfield.operators.search import search_request

    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )
    local = {0: [r.embedding for r in coll.where("id = 0").collect()][0]}
    base = sorted((r.query_id, r.id) for r in search(coll, local, cutoff=0.2, limit=50).collect())
    pg = search_request(coll, local, "pgvector", {"certainty": 0.2, "limit": 50})
    wv = search_request(coll, local, "weaviate", {"certainty": 0.6, "limit": 50})
    ch = search_request(coll, local, "chroma", {"threshold": 0.8, "limit": 50})
    mv = search_request(coll, local, "milvus", {"threshold": 0.2, "limit": 50, "anns_field": "embedding",
                                                "output_fields": ["label"], "expr": "label >= 0"})
    for df in (pg, wv, ch, mv):
        assert sorted((r.query_id, r.id) for r in df.collect()) == base
    assert "label" in mv.columns
    with pytest.raises(KeyError):
        search_request(coll, local, "milvus", {"threshold": 0.2})
    with pytest.raises(KeyError):
        search_request(coll, local, "weaviate", {"limit": 5})
    with pytest.raises(ValueError):
        search_request(coll, local, "nosuchstore", {})
    ip = search_request(coll, local, "pgvector", {"metric_type": "IP", "limit": 3})
    assert ip.count() == 3


def test_row_chunked_scoring_equals_whole_batches(spark, monkeypatch):
    from nearfield.functions.vectors import pack_f32
    from nearfield.operators import scoring

    coll = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )
    packed = coll.select("id", pack_f32("embedding").alias("embedding"), "label")
    q = coll.where("id < 4").select(F.col("id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r.id, round(r.score, 12), r.label) for r in df.collect())
    whole = [key(search(c, q, cutoff=0.1, limit=30, carry=("label",))) for c in (coll, packed)]
    monkeypatch.setattr(scoring, "_CHUNK_ELEMS", 64 * 5)  # 5-row slices
    sliced = [key(search(c, q, cutoff=0.1, limit=30, carry=("label",))) for c in (coll, packed)]
    assert whole[0] == whole[1] == sliced[0] == sliced[1]


def test_registered_metric_and_store(spark):
    from pyspark.sql import functions as F

    from nearfield.operators.scoring import Metric, register_metric
    from nearfield.operators.search import Profile, ScoreRule, register_profile, requests_table, search_request, search_requests

    def largest(rows, queries):
        return np.stack([np.abs(rows - q).max(axis=1) for q in queries], axis=1)

    def column(v, q):
        return F.array_max(F.zip_with(v, q, lambda a, b: F.abs(a - b)))

    with pytest.raises(ValueError):
        ScoreRule("chebyshev")
    register_metric("Chebyshev", Metric(largest, higher_is_better=False, column=column))
    register_profile(Profile("tiles", ScoreRule("chebyshev"), 2.0, 3), cutoff_key="reach")
    data = [(1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [3.0, 0.0]), (4, None), (5, [1.0]), (6, [1.0, -2.0]), (7, [0.0, 0.0]), (8, [0.5, 0.5])]
    coll = spark.createDataFrame(data, "id long, embedding array<double>")
    q = {0: [0.0, 0.0]}
    got = search_request(coll, q, "tiles").orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 0.0), (7, 0.0), (8, 0.5)]
    got = search_request(coll, q, "tiles", {"reach": 3.0, "limit": 10}).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 7, 8, 2, 6, 3]
    same = search(coll, q, rule=ScoreRule("chebyshev"), cutoff=3.0, limit=10, method="sql").orderBy("rank").collect()
    assert [(r.id, r.score) for r in same] == [(r.id, r.score) for r in got]
    by_request = search_request(coll, q, "pgvector", {"metric_type": "CHEBYSHEV", "certainty": 3.0, "limit": 10})
    assert sorted(r.id for r in by_request.collect()) == [1, 2, 3, 6, 7, 8]
    assert ScoreRule("chebyshev", "distance").higher_is_better and not ScoreRule("chebyshev").higher_is_better
    for taken in (lambda: register_metric("L2", Metric(largest, False)), lambda: register_profile(Profile("Milvus", ScoreRule(), None, 1))):
        with pytest.raises(ValueError):
            taken()
    with pytest.raises(ValueError):
        search_requests(coll, requests_table(spark, [(0, [0.0, 0.0], "tiles", None)]), id_col="id")


def test_batch_of_many_cells_joins_the_top_hits_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    from nearfield.operators import scoring

    n_cells, per, q, cap, d = 20, 5, 10, 3, 4
    rng = np.random.default_rng(3)
    X, Q = rng.standard_normal((n_cells * per, d)), rng.standard_normal((q, d))

    class Sent:
        value = (np.arange(q), Q, {c: np.arange(q) for c in range(n_cells)})

    met = []
    best = scoring._topk_per_query
    monkeypatch.setattr(scoring, "_topk_per_query", lambda parts, *a: met.append(sum(p.num_rows for p in parts)) or best(parts, *a))
    monkeypatch.setattr(scoring, "_FOUND_ROWS", 40, raising=False)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    run = scoring.make_batch_scorer(
        Sent, metric="cosine", transform="identity", higher_is_better=True, cutoff=None, cap=cap,
        id_col="id", vec_col="v", carry=(), out_schema=schema, cell_col="cell",
    )
    cells = np.repeat(np.arange(n_cells), per)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(X))), pa.array(X.tolist()), pa.array(cells)], names=["id", "v", "cell"])
    found = pa.Table.from_batches(run([batch])).to_pydict()
    S = (X / np.linalg.norm(X, axis=1, keepdims=True)) @ (Q / np.linalg.norm(Q, axis=1, keepdims=True)).T
    want = {(j, int(i)) for j in range(q) for i in np.argsort(-S[:, j])[:cap]}
    assert set(zip(found["query_id"], found["id"], strict=True)) == want
    assert max(met) <= 2 * q * cap + 2 * 40
