"""Filter and refine over one-byte codes against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import codes as CD
from nearfield.operators.search import search

DIM = 24


def rows_of(seed=3, n=400):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, DIM))
    X[: n // 2] = np.eye(DIM)[rng.integers(0, 3, n // 2)] + 0.05 * X[: n // 2]
    X[5] = 1e-20 * X[5]
    X[6] = 1e18 * X[6]
    good = [(i, [float(v) for v in x], f"n{i}") for i, x in enumerate(X)]
    bad = [(9001, [0.0] * DIM, ""), (9002, None, ""), (9003, [1.0], ""), (9004, [float("nan")] * DIM, None), (9005, [None] + [0.5] * (DIM - 1), "")]
    return good + bad + good[:3]  # repeated rows


def make(spark):
    return spark.createDataFrame(rows_of(), "id long, embedding array<double>, name string").repartition(5)


def key(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("cutoff", [0.9, 0.3, -1.0])
def test_equals_exact_search(spark, tmp_path, cutoff):
    coll = make(spark)
    CD.save_codes(CD.build_codes(coll, DIM), str(tmp_path / "codes"))
    index = CD.load_codes(spark, str(tmp_path / "codes"), DIM)
    queries = coll.where("id % 40 = 0").distinct().select(F.col("id").alias("query_id"), "embedding")
    got = CD.code_search(index, queries, cutoff=cutoff)
    want = search(coll, queries, cutoff=cutoff, id_col="id")
    assert key(got) == key(want) and want.count() > 0
    # Blocks of one or two queries give the same.
    assert key(CD.code_search(index, queries, cutoff=cutoff, budget_bytes=2 * DIM * 8)) == key(want)
    top = CD.code_search(index, queries, cutoff=cutoff, limit=3)
    assert {(r["query_id"], r["rank"]): round(r["score"], 9) for r in top.collect()} == {
        (r["query_id"], r["rank"]): round(r["score"], 9) for r in search(coll, queries, cutoff=cutoff, limit=3, id_col="id").collect()
    }


def test_bound_holds_and_filter_reads_no_vector(spark, tmp_path):
    """No row within the bound is dropped, few others are kept, and the first pass reads codes only."""
    coll = make(spark)
    CD.save_codes(CD.build_codes(coll, DIM), str(tmp_path / "codes"))
    index = CD.load_codes(spark, str(tmp_path / "codes"), DIM)
    X = {i: np.array(v) for i, v, _ in rows_of() if i < 9000}
    U = {i: v / np.linalg.norm(v) for i, v in X.items()}
    q = np.array([U[0], U[250]])
    first = CD.code_candidates(index, np.array([0, 250]), q, 0.5, "id")
    kept = {(int(k), r["id"]) for r in first.collect() for k in r["queries"]}
    for n, k in enumerate((0, 250)):
        near = {i for i, u in U.items() if u @ q[n] >= 0.5}
        assert near <= {i for j, i in kept if j == k}
        assert {i for j, i in kept if j == k} <= {i for i, u in U.items() if u @ q[n] >= 0.5 - 0.1}
    plan = first._jdf.queryExecution().toString()
    assert "embedding" not in plan.split("== Physical Plan ==")[1]
    # The survivors of a selective search stand in some of the parts only.
    parts = index.data.select("cell").distinct().count()
    first = CD.code_candidates(index, np.array([0]), q[:1], 0.95, "id")
    assert first.select("cell").distinct().count() < parts


def test_edges(spark):
    coll = make(spark)
    index = CD.build_codes(coll, DIM)
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert CD.code_search(index, none, cutoff=0.5).count() == 0
    short = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert CD.code_search(index, short, cutoff=0.5).count() == 0
    empty = CD.build_codes(coll.limit(0), DIM)
    assert CD.code_search(empty, spark.createDataFrame([(1, [1.0] * DIM)], "query_id long, embedding array<double>"), cutoff=0.5).count() == 0
    size = CD.scanned_bytes(index).first()
    assert (size["n_rows"], size["code_bytes"], size["vector_bytes"]) == (403, 403 * (DIM + 16), 403 * 4 * DIM)
    assert CD.scanned_bytes(empty).first()["code_bytes"] == 0
    with pytest.raises(ValueError, match="code"):
        CD.build_codes(coll.withColumn("code", F.lit(1)), DIM)
