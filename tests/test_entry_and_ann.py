"""Driver contract, a sample of oracle comparisons, IVF properties, extraction."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from nearfield.operators.ann import build_ivf, ivf_search
from nearfield.operators.extract import extract_embeddings, split_ok
from nearfield.operators.search import search
from nearfield.plans.catalog import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert df.columns[:6] == ["query_id", "n_hits", "tp", "fp", "fn", "tn"]


def test_oracles_are_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def _duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 9) if isinstance(v, float) else (tuple(v) if isinstance(v, list) else v) for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "name",
    ["flagship_search_eval", "batch_knn_topk", "confusion_multi_target", "latency_summary_wide",
     "iteration_numbering", "collection_upsert", "results_summary_pivot"],
)
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SF)
    cur = _duck().execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    spark_rows = [tuple(r[c] for c in sorted(cols)) for r in df.collect()]
    duck = [dict(zip(cols, r)) for r in cur.fetchall()]
    duck_rows = [tuple(r[c] for c in sorted(cols)) for r in duck]
    assert _norm(spark_rows) == _norm(duck_rows)


def test_ivf_full_probe_is_exact_and_subset(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 16))
    rows = [(i, (centers[i % 4] + 0.05 * rng.normal(size=16)).tolist()) for i in range(400)]
    coll = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = coll.where("id < 8").select(F.col("id").alias("query_id"), "embedding")
    index = build_ivf(coll, 4)
    exact = {(r.query_id, r.id) for r in search(coll, q, limit=20).collect()}
    full = {(r.query_id, r.id) for r in ivf_search(index, q, 4, limit=20).collect()}
    one = {(r.query_id, r.id) for r in ivf_search(index, q, 1, cutoff=0.0).collect()}
    assert full == exact
    all_exact = {(r.query_id, r.id) for r in search(coll, q, cutoff=0.0).collect()}
    assert one <= all_exact
    # planted clusters: one probe already finds the whole top-20
    one_top = {(r.query_id, r.id) for r in ivf_search(index, q, 1, limit=20).collect()}
    assert len(one_top & exact) / len(exact) > 0.95


def test_extraction_flat_map_and_errors(spark):
    items = spark.createDataFrame([(1, "ab\n\ncd"), (2, "123\n456"), (3, None)], "id long, text string")

    def factory():
        def embed(text):
            if text is None:
                raise ValueError("unreadable")
            out = [(i, [float(len(x))]) for i, x in enumerate(text.split("\n")) if x.isalpha()]
            return out
        return embed

    ok, bad = split_ok(extract_embeddings(items, factory, "id", "text"))
    assert sorted((r.item_id, r.part_no) for r in ok.collect()) == [(1, 0), (1, 2)]
    assert [r.item_id for r in bad.collect()] == [3]


def test_load_timer(spark):
    from nearfield.plans.harness import load_benchmark
    from nearfield.session import scratch_path

    coll = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    detail, summary = load_benchmark(spark, coll, scratch_path(spark, "test-load"), dim=64, id_col="vec_id", iterations=2)
    assert detail.count() == 2
    assert {"insertion_time_mean", "deletion_time_p95"} <= {r.metric for r in summary.collect()}


def test_lsh_search_properties(spark):
    from nearfield.operators.ann import build_lsh, lsh_search

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 16))
    rows = [(i, (centers[i % 4] + 0.05 * rng.normal(size=16)).tolist()) for i in range(400)]
    coll = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = coll.where("id < 8").select(F.col("id").alias("query_id"), "embedding")
    index = build_lsh(coll, 6, dim=16)
    exact = {(r.query_id, r.id) for r in search(coll, q, limit=20).collect()}
    full = {(r.query_id, r.id) for r in lsh_search(index, q, 6, limit=20).collect()}
    assert full == exact
    near = {(r.query_id, r.id) for r in lsh_search(index, q, 1, cutoff=0.0).collect()}
    assert near <= {(r.query_id, r.id) for r in search(coll, q, cutoff=0.0).collect()}
    top = {(r.query_id, r.id) for r in lsh_search(index, q, 1, limit=20).collect()}
    assert len(top & exact) / len(exact) > 0.9


def test_ivf_candidate_pool(spark):
    import tempfile

    from nearfield.operators.ann import build_ivf, ivf_search, load_ivf, save_ivf

    rng = np.random.default_rng(9)
    centers = rng.normal(size=(4, 16))
    rows = [(i, (centers[i % 4] + 0.05 * rng.normal(size=16)).tolist()) for i in range(400)]
    coll = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = coll.where("id < 4").select(F.col("id").alias("query_id"), "embedding")
    path = tempfile.mkdtemp(prefix="ivfc-")
    save_ivf(build_ivf(coll, 4), path)
    index = load_ivf(spark, path)
    assert index.counts.sum() == 400
    Q = np.array([r.embedding for r in q.orderBy("query_id").collect()])
    assert sorted(q for qs in index.probes_for_candidates(Q, 1).values() for q in qs) == [0, 1, 2, 3]
    assert {c: sorted(qs) for c, qs in index.probes_for_candidates(Q, 400).items()} == {c: [0, 1, 2, 3] for c in range(4)}
    exact = {(r.query_id, r.id) for r in search(coll, q, limit=10).collect()}
    pool = {(r.query_id, r.id) for r in ivf_search(index, q, num_candidates=400, limit=10).collect()}
    assert pool == exact


def test_search_request_with_index(spark):
    import tempfile

    from nearfield.operators.ann import build_ivf, load_ivf, save_ivf
    from nearfield.operators.search import search_request

    coll = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    path = tempfile.mkdtemp(prefix="ivfr-")
    save_ivf(build_ivf(coll, 4, max_iter=5), path)
    index = load_ivf(spark, path)
    local = {0: [r.embedding for r in coll.where("id = 0").collect()][0]}
    exact = sorted((r.query_id, r.id) for r in search(coll, local, limit=10).collect())
    full = search_request(coll, local, "elasticsearch",
                          {"certainty": 0.0, "limit": 10, "num_candidates": 10_000}, index=index)
    assert sorted((r.query_id, r.id) for r in full.collect()) == sorted(
        (q, i) for q, i in exact
    )


def test_every_oracle_binds_in_duckdb():
    con = _duck()
    for name, sql in E.oracle_sql().items():
        con.execute("EXPLAIN " + sql)  # raises on a syntax or binding error
    # Every query of the library has an oracle; operators that SQL cannot express have tests of their own.
    rows_only = set(E.queries()) - set(E.oracle_sql())
    assert all(name == "pipeline" or re.match(r"op\d+_", name) for name in rows_only)


def test_store_rules_select_the_same_hits(spark):
    qs = E.queries()
    key = lambda name: sorted((r.query_id, r.vec_id, r.rank) for r in qs[name](spark, SF).collect())
    base = key("exact_threshold_search")
    assert base and key("search_profile_half_shift") == base == key("search_profile_distance")


def test_entry_module_imports_without_a_session():
    import subprocess
    import sys as _sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    out = subprocess.run([_sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
    n_queries, n_oracles = map(int, out.stdout.split())
    assert n_queries == len(E.queries()) and n_oracles == len(E.oracle_sql()) >= 71
