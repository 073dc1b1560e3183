"""Size switches, null keys, ties, request keys, malformed input: rules that hold at every size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import unpack_f32
from nearfield.operators import ranking, stats
from nearfield.operators.ann import build_lsh, load_lsh, lsh_search, save_lsh
from nearfield.operators.collection import Collection
from nearfield.operators.extract import extract_embeddings, write_split
from nearfield.operators.scoring import make_batch_scorer
from nearfield.operators.search import query_slices, search, search_request
from nearfield.session import checkpoint_dir, scratch_path


class _Local:
    def __init__(self, value):
        self.value = value


def test_scorer_emits_at_most_its_top_k_per_task():
    rng = np.random.default_rng(0)
    queries, limit, rows = 201, 10_000, 12_000
    Q = rng.normal(size=(queries, 4))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    run = make_batch_scorer(
        _Local((np.arange(queries), Q)), metric="ip", transform="identity", higher_is_better=True, cutoff=None,
        cap=limit, id_col="id", vec_col="v", carry=(), out_schema=schema,
    )
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(np.arange(a, a + 4000)), pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=16_000)), 4).cast(pa.list_(pa.float64()))],
            names=["id", "v"],
        )
        for a in range(0, rows, 4000)
    ]
    out = pa.Table.from_batches(list(run(batches)))
    counts = np.bincount(out.column("query_id").to_numpy())
    assert len(counts) == queries and (counts == limit).all()


def test_query_slices_hold_one_block_at_a_time():
    taken = []

    def rows():
        for i in range(10):
            taken.append(i)
            yield i

    slices = query_slices(rows(), 4)
    assert next(slices) == [0, 1, 2, 3] and len(taken) == 4
    assert [len(b) for b in slices] == [4, 2]


def test_sliced_queries_give_the_same_hits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(900, [1.0, 2.0])]
    coll = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = coll.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r.id, r.rank) for r in df.collect())
    whole = key(search(coll, q, limit=15))
    assert whole == key(search(coll, q, limit=15, budget_bytes=3 * 64))
    # a query of another length meets only rows of that length, in any block
    assert [(r[0], r[1]) for r in whole if r[0] == 900] == [(900, 900)]
    with pytest.raises(ValueError):
        search(coll, q)


def test_null_group_keys_on_both_paths(spark):
    rows = [(None, 1, 5.0), (None, 2, 7.0), ("a", 3, 1.0), ("a", 4, 2.0), ("a", 5, 9.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumn("ok", F.lit(True))
    for f in (
        lambda n: stats.deltas(df, ["k"], ["t"], "v", single_task_rows=n).select("k", "t", "delta"),
        lambda n: stats.iteration_numbers(df, ["k"], ["t"], "ok", single_task_rows=n).select("k", "t", "iteration"),
        lambda n: stats.latency_summary(df, "v", ["k"], single_task_rows=n),
        lambda n: ranking.ordered_positions(df, ["k"], ["t"], single_task_rows=n).select("k", "t", "pos"),
    ):
        one, spread = (
            sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(n).collect()), key=str) for n in (None, 0)
        )
        assert one == spread and any(None in r for r in one)
    p = {r.k: r.p90 for r in stats.latency_summary(df, "v", ["k"]).collect()}
    assert p[None] == pytest.approx(6.8)


def test_equal_values_are_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.lit(3.0).alias("v"))
    got = stats.exact_percentiles(df, "v", ["k"], num_partitions=8, single_task_rows=0).first()
    assert (got.p90, got.p99) == (3.0, 3.0)
    ranked = ranking.positions(df.withColumn("t", F.monotonically_increasing_id()), ["k"], ["v", "t"], num_partitions=8)
    assert sorted(r.pos for r in ranked.collect()) == list(range(20_000))


def test_global_ids_have_no_one_task_exchange(spark):
    df = ranking.ordered_positions(spark.range(1000).withColumn("x", F.rand(1)), [], ["x"])
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in df.collect()) == list(range(1000))


def test_request_filter_and_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 5) for i in range(100)]
    coll = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    path = scratch_path(spark, "test-lsh")
    save_lsh(build_lsh(coll, 4, dim=6), path)
    index = load_lsh(spark, path)
    q = {0: rows[3][1]}
    hits = lsh_search(index, q, 4, limit=100, prefilter="label = 3", carry=("label",)).collect()
    exact = search(coll, q, limit=100, prefilter="label = 3", carry=("label",)).collect()
    assert {r.label for r in hits} == {3} and sorted(r.id for r in hits) == sorted(r.id for r in exact)
    near = {r.id for r in lsh_search(index, q, 0, limit=100).collect()}
    assert 3 in near and len(near) < 100
    with pytest.raises(KeyError):
        search_request(coll, q, "pgvector", {"exprs": "label = 3"})


def test_malformed_packed_vectors_are_null(spark):
    good = np.array([2.0, 3.0], "<f4").tobytes()
    df = spark.createDataFrame([(1, b"abcdef"), (2, good), (3, None), (4, b"")], "id int, b binary").coalesce(1)
    got = {r.id: r.v for r in df.select("id", unpack_f32("b").alias("v")).collect()}
    assert got == {1: None, 2: [2.0, 3.0], 3: None, 4: []}


def test_upsert_keeps_the_newest(spark):
    c = Collection(spark, scratch_path(spark, "test-coll"), "c", dim=2).create()
    rows = [(1, [1.0, 0.0], "old", 1), (1, [0.0, 1.0], "new", 2), (2, [1.0, 1.0], "only", None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, image_path string, version int").repartition(3)
    c.upsert(df, order_col="version")
    assert sorted((r.id, r.image_path) for r in c.read().collect()) == [(1, "new"), (2, "only")]


def test_string_items_and_batch_embedders(spark):
    items = spark.createDataFrame([("img/a.jpg", "ab"), ("img/b.jpg", "bad"), (None, "c")], "image_path string, text string")

    def factory():
        def embed(texts):
            return [ValueError("no") if t == "bad" else [(None, [float(len(t))])] for t in texts]

        return embed

    got = extract_embeddings(items, None, "image_path", "text", batch_embedder_factory=factory)
    ok, bad = write_split(got, scratch_path(spark, "test-sides"))
    assert sorted(((r.item_id, r.embedding) for r in ok.collect()), key=str) == [("img/a.jpg", [2.0]), (None, [1.0])]
    assert [tuple(r) for r in bad.collect()] == [("img/b.jpg", "ValueError: no")]


def test_scratch_paths_are_under_the_shared_folder(spark):
    base = checkpoint_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/") + "/")


def _data_files(c):
    """Data files by bucket."""
    files = c._rows().select("bucket", F.input_file_name().alias("path")).distinct().collect()
    return {b: {r.path for r in files if r.bucket == b} for b in {r.bucket for r in files}}


def test_upsert_of_few_ids_leaves_other_buckets_alone(spark):
    c = Collection(spark, scratch_path(spark, "test-coll"), "c", dim=1, n_buckets=8).create()
    rows = spark.range(400).select("id", F.array(F.col("id").cast("float")).alias("embedding"), F.lit("a").alias("image_path"))
    c.append(rows)
    before = _data_files(c)
    c.upsert(rows.where("id = 7").withColumn("image_path", F.lit("b")))
    after = _data_files(c)
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {r.id for r in c.read().where("image_path = 'b'").collect()} == {7} and c.read().count() == 400
    c.append(rows.where("id = 9"))
    c.delete_where("id = 9")
    assert c.read().count() == 399
    assert sum(before[b] != _data_files(c)[b] for b in before) <= 2
    c.truncate()
    assert c.read().count() == 0
    c.append(rows.limit(3))
    assert c.read().count() == 3


def test_many_small_appends_are_compacted(spark):
    c = Collection(spark, scratch_path(spark, "test-coll"), "c", dim=1, n_buckets=2).create()
    for i in range(4):
        c.append(spark.range(i * 10, i * 10 + 10).select("id", F.array(F.lit(1.0)).alias("embedding")))
    c.compact(max_files=2)
    assert all(len(d) == 1 for d in _data_files(c).values()) and c.read().count() == 40
