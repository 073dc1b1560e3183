"""Searches with measured recall, bounded cells, mixed requests, whole files, sweeps and as-of joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.ann import build_ivf
from nearfield.operators.evaluate import mean_average_precision, threshold_sweep
from nearfield.operators.probes import (
    bounded_search,
    build_multi_lsh,
    load_bounded,
    load_multi_lsh,
    multi_lsh_search,
    pooled_recall,
    save_bounded,
    save_multi_lsh,
    tune,
    with_reach,
)
from nearfield.operators.ranking import last_before, running_sums
from nearfield.operators.search import (
    ScoreRule,
    requests_table,
    resolve_request,
    search,
    search_request,
    search_requests,
)
from nearfield.sources import files as FS

DIM = 16


def clustered(spark, n_clusters=8, per=40, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.eye(DIM)[:n_clusters]
    X = np.repeat(centres, per, axis=0) + rng.normal(0, spread, (n_clusters * per, DIM))
    rows = [(i, [float(v) for v in x], i // per) for i, x in enumerate(X)]
    bad = [(9001, [0.0] * DIM, 0), (9002, None, 0), (9003, [1.0, 2.0], 0), (9004, [float("nan")] + [0.5] * (DIM - 1), 0)]
    coll = spark.createDataFrame(rows + bad, "id long, embedding array<float>, label int")
    return coll, centres


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_bounded_cells_are_exact_and_read_few(spark, tmp_path):
    coll, centres = clustered(spark)
    save_bounded(with_reach(build_ivf(coll, 8, centroids=centres)), str(tmp_path / "cells"))
    index = load_bounded(spark, str(tmp_path / "cells"))
    queries = coll.where("id < 9000 AND id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    probed = []
    got = bounded_search(index, queries, limit=5, probed=probed)
    assert hits(got) == hits(search(coll, queries, limit=5))
    assert sum(probed) < queries.count() * index.index.n_cells / 2
    cut = bounded_search(index, queries, cutoff=0.9, limit=500, rule=ScoreRule("cosine", "half_shift"), probed=(few := []))
    assert hits(cut) == hits(search(coll, queries, cutoff=0.9, limit=500, rule=ScoreRule("cosine", "half_shift")))
    assert sum(few) < queries.count() * index.index.n_cells / 2
    far = bounded_search(index, queries, cutoff=0.3, limit=1000, rule=ScoreRule("cosine", "distance"))
    assert hits(far) == hits(search(coll, queries, cutoff=0.3, limit=1000, rule=ScoreRule("cosine", "distance")))
    assert bounded_search(index, queries, cutoff=1.5, limit=5).count() == 0
    with pytest.raises(ValueError):
        bounded_search(index, queries, rule=ScoreRule("l2"), limit=3)


def test_bounded_cells_on_spread_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(300, DIM)))]
    coll = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = with_reach(build_ivf(coll, 12, centroids=rng.normal(size=(12, DIM))))
    queries = coll.where("id % 25 = 0").select(F.col("id").alias("query_id"), "embedding")
    assert hits(bounded_search(index, queries, limit=7)) == hits(search(coll, queries, limit=7))


def test_multi_lsh_counts_a_row_once_and_reaches_recall(spark, tmp_path):
    coll, _ = clustered(spark, spread=0.2)
    save_multi_lsh(build_multi_lsh(coll, 4, 5, DIM), str(tmp_path / "lsh"))
    index = load_multi_lsh(spark, str(tmp_path / "lsh"))
    queries = coll.where("id < 9000 AND id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = search(coll, queries, limit=10)
    run = lambda q, n: multi_lsh_search(index, q, n, limit=10)
    n = tune(run, lambda q: search(coll, q, limit=10), queries, (1, 2, 4, 8, 16), "id")
    got = run(queries, n)
    assert got.groupBy("query_id", "id").count().where("count > 1").isEmpty()
    found, k = pooled_recall(got, exact, "id")
    assert found >= 0.9 * k
    assert hits(run(queries, 31)) == hits(exact)  # all cells within the flips


def test_probe_order_is_by_margin():
    from nearfield.operators.probes import MultiLSH

    index = MultiLSH(np.array([np.eye(4)]), None)
    cells = index.probes(np.array([[0.9, -0.1, 0.5, 0.2]]), 3)
    assert sorted(cells) == sorted([0b1101, 0b1111, 0b0101])


# The published search requests of the stores.
PUBLISHED = {
    "milvus": {"anns_field": "embedding", "metric_type": "COSINE", "index_params": {"ef": 10000}, "limit": None, "threshold": 0.6, "output_fields": ["id", "image_path"]},
    "chroma": {"threshold": 0.6, "limit": 10000},
    "elasticsearch": {"certainty": 0.6, "limit": 10000, "num_candidates": 10000},
    "pgvector": {"certainty": 0.6, "limit": 10000},
    "qdrant": {"certainty": 0.6, "limit": 10000},
    "weaviate": {"certainty": 0.6, "limit": 10000},
}


def test_published_requests_run_unchanged(spark):
    coll, centres = clustered(spark)
    coll = coll.withColumn("image_path", F.concat(F.lit("img/"), "id"))
    for store, params in PUBLISHED.items():
        got = search_request(coll, {0: centres[0]}, store, params)
        assert got.count() > 0 and ("image_path" in got.columns) == (store == "milvus"), store
    r = resolve_request("milvus", PUBLISHED["milvus"])
    assert (r.limit, r.candidates, r.carry) == (16000, 10000, ("image_path",))
    index = build_ivf(coll, 8, centroids=centres)
    assert search_request(coll, {0: centres[0]}, "milvus", PUBLISHED["milvus"], index=index).count() > 0
    with pytest.raises(KeyError):
        resolve_request("pgvector", {"certainity": 0.6})


def test_mixed_requests_equal_single_ones(spark):
    coll, centres = clustered(spark, spread=0.3)
    coll = coll.withColumn("image_path", F.lit("img"))
    asked, single = [], []
    for q in range(3):
        for store, params in PUBLISHED.items():
            asked.append((q, centres[q], store, {**params, "limit": 7 + q}))
    asked += [(5, centres[5], "milvus", {"anns_field": "embedding", "metric_type": "L2", "threshold": 1.2, "limit": 9})]
    asked += [(6, centres[6] * 2, "qdrant", {"metric_type": "IP", "certainty": 0.4, "limit": 30})]
    got = search_requests(coll, requests_table(spark, asked))
    for q, vector, store, params in asked:
        single += [(q, store, *h[1:]) for h in hits(search_request(coll, {q: vector}, store, params))]
    assert sorted((r["query_id"], r["store"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect()) == sorted(single)
    blocks = search_requests(coll, requests_table(spark, asked), budget_bytes=5 * DIM * 8)
    assert blocks.count() == len(single)
    with pytest.raises(ValueError):
        search_requests(coll, requests_table(spark, asked).withColumn("cutoff", F.lit(None).cast("double")).withColumn("max_hits", F.lit(None).cast("int")))


def test_a_file_that_breaks_midway_gives_no_row(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name in ("good", "midway", "cut", "other"):
        rows = [([float(v) for v in x], f"{name}/{i}") for i, x in enumerate(rng.normal(size=(3000, 8)))]
        df = spark.createDataFrame(rows, FS.EMBEDDING_SCHEMA).coalesce(1)
        df.write.option("parquet.block.size", 40_000).option("parquet.page.size", 4_000).parquet(str(tmp_path / name))
    for name, change in (("midway", lambda b: b[: len(b) // 2] + b[len(b) // 2 + 64 :]), ("cut", lambda b: b[: len(b) // 2])):
        path = next((tmp_path / name).glob("part-*.parquet"))
        path.write_bytes(change(path.read_bytes()))
        for crc in (tmp_path / name).glob(".*.crc"):
            crc.write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("good", "midway", "cut", "other", "absent")]
    report = FS.check_embedding_files(spark, paths)
    bad = {r["path"].split("/")[-2 if r["reason"] != "missing" else -1]: r["reason"] for r in report.where("NOT ok").collect()}
    assert set(bad) == {"midway", "cut", "absent"} and bad["absent"] == "missing" and bad["midway"].startswith("broken: ")
    rows = FS.read_embedding_files(spark, paths)
    assert rows.count() == 6000 and not rows.where("image_path LIKE 'midway%'").count()
    with pytest.raises(ValueError):
        FS.read_embedding_files(spark, [str(tmp_path / "cut")])


def test_sweep_of_a_hot_query(spark):
    rng = np.random.default_rng(3)
    rows = [(0, round(float(s), 2), int(y)) for s, y in zip(rng.random(900), rng.random(900) < 0.3, strict=True)]
    rows += [(1, round(float(s), 1), 0) for s in rng.random(20)] + [(None, 0.5, 1), (None, 0.4, 0), (0, None, 1)]
    scored = spark.createDataFrame(rows, "q int, score double, y_true int").repartition(5)
    sweep = threshold_sweep(scored, ["q"])
    got = {(r["q"], r["threshold"]): (r["tp"], r["fp"], r["fn"], r["recall"]) for r in sweep.collect()}
    aps = []
    for q in (0, 1, None):
        own = [(s, y) for g, s, y in rows if g == q and s is not None]
        pos = sum(y for g, s, y in rows if g == q)
        ap, last = 0.0, 0
        for t in sorted({s for s, _ in own}, reverse=True):
            tp = sum(y for s, y in own if s >= t)
            n = sum(s >= t for s, _ in own)
            assert got[q, t] == (tp, n - tp, pos - tp, tp / pos if pos else None)
            ap, last = ap + tp / n * (tp - last), tp
        aps += [ap / pos] if pos else []
    r = mean_average_precision(sweep, ["q"]).first()
    assert r["n_queries"] == len(aps) and r["mean_average_precision"] == pytest.approx(np.mean(aps))


def test_running_sums_and_last_before_cross_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), i, float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 300), rng.normal(size=300), strict=True))]
    df = spark.createDataFrame(rows, "g int, at int, v double").repartition(7)
    got = {(r["g"], r["at"]): r["s"] for r in running_sums(df, ["g"], [F.col("at")], {"s": "v"}).collect()}
    sums = {0: 0.0, 1: 0.0}
    for g, at, v in rows:
        sums[g] += v
        assert got[g, at] == pytest.approx(sums[g])
    samples = spark.createDataFrame([(0, 10 * i, float(i)) for i in range(40)] + [(0, 50, 99.0), (2, 7, 1.0)], "g int, at int, m double")
    probes = spark.createDataFrame([(i, i % 3, 3 * i - 20) for i in range(200)], "p int, g int, at int")
    got = {r["p"]: r["m"] for r in last_before(samples, probes, ["g"], "at", ["m"]).collect()}
    known = {0: {10 * i: float(i) for i in range(40)} | {50: 99.0}, 1: {}, 2: {7: 1.0}}
    for i in range(200):
        earlier = [t for t in known[i % 3] if t <= 3 * i - 20]
        assert got[i] == (known[i % 3][max(earlier)] if earlier else None), i
