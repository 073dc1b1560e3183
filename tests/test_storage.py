"""Collections, files and small function rules (FIXTURES §3: upsert, boxes,
mixed CSV, files)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from nearfield.functions import scalars as S
from nearfield.operators.collection import Collection
from nearfield.sources import files as FS


def _batch(spark, ids, path):
    return spark.createDataFrame(
        [(i, [float(i), 1.0], path) for i in ids], "id long, embedding array<double>, image_path string"
    )


def _coll(spark):
    return Collection(spark, tempfile.mkdtemp(prefix="coll-"), "c", dim=2).create()


def _state(c):
    return sorted((r.id, r.image_path) for r in c.read().collect())


def test_write_modes(spark):
    up = _coll(spark)
    up.append(_batch(spark, [1, 2], "old"))
    up.upsert(_batch(spark, [2, 3], "new"))
    assert _state(up) == [(1, "old"), (2, "new"), (3, "new")]

    ig = _coll(spark)
    ig.append(_batch(spark, [1, 2], "old"))
    ig.insert_ignore(_batch(spark, [2, 3], "new"))
    assert _state(ig) == [(1, "old"), (2, "old"), (3, "new")]

    ap = _coll(spark)
    ap.append(_batch(spark, [1, 2], "old"))
    ap.append(_batch(spark, [2, 3], "new"))
    assert sorted(r.id for r in ap.read().collect()) == [1, 2, 2, 3]


def test_truncate_delete_drop(spark):
    c = _coll(spark)
    c.append(_batch(spark, [1, 2, 3], "p"))
    c.delete_where("id >= 2 OR image_path IS NULL")
    assert _state(c) == [(1, "p")]
    c.truncate()
    assert c.read().count() == 0 and c.exists()
    c.drop()
    c.drop()  # no error when absent
    assert not c.exists()


def test_guards(spark):
    c = _coll(spark)
    c.append(spark.createDataFrame([], "id long, embedding array<float>"))  # B7: skipped
    assert c.read().count() == 0
    with pytest.raises(TypeError):
        c.append(spark.createDataFrame([(1, ["a"])], "id long, embedding array<string>"))
    with pytest.raises(ValueError):
        c.append(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, embedding array<float>"))
    with pytest.raises(ValueError):
        c.append(spark.createDataFrame([(1,)], "id long"))


def test_box_clip_and_base_name(spark):
    lo, hi = S.clip_box(F.lit(-5), F.lit(20), F.lit(10))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), S.base_name(F.lit("a/b/")).alias("b")).first()
    assert (r.lo, r.hi, r.b) == (0, 10, "")


def test_mixed_results_csv(spark):
    d = tempfile.mkdtemp(prefix="res-")
    p = os.path.join(d, "vector_search_results_threads_10_iterations_2_database_PGVECTOR_2025-04-22_06-47-01_man.csv")
    with open(p, "w") as f:
        f.write("iteration,search_time,precision,recall,f1_score\n1,0.5,1.0,0.5,0.6\n2,0.7,1.0,0.5,0.6\n")
        f.write("search_time_mean,0.6\nrps,3.5\n")
    raw = FS.read_result_csvs(spark, p)
    det = FS.result_details(raw).collect()
    summ = {r.metric: r.value for r in FS.result_summary(raw).collect()}
    assert [r.iteration for r in sorted(det, key=lambda r: r.iteration)] == [1, 2]
    assert det[0].database == "PGVECTOR" and det[0].specificity is None
    assert summ == {"search_time_mean": 0.6, "rps": 3.5}


def test_embedding_files_skip_bad(spark):
    d = tempfile.mkdtemp(prefix="emb-")
    good = os.path.join(d, "good.parquet")
    spark.createDataFrame([([1.0, 2.0], "x/a.jpg")], FS.EMBEDDING_SCHEMA).coalesce(1).write.parquet(good)
    bad = os.path.join(d, "bad.parquet")
    with open(bad, "wb") as f:
        f.write(b"not a parquet file")
    missing = os.path.join(d, "missing.parquet")
    df = FS.read_embedding_files(spark, [good, bad, missing])
    assert df.count() == 1
    with pytest.raises((FileNotFoundError, ValueError)):
        FS.read_embedding_files(spark, [missing])
    with pytest.raises(Exception):
        FS.read_embedding_files(spark, [bad]).count()


def test_failed_write_leaves_the_collection_alone(spark):
    c = _coll(spark)
    c.append(_batch(spark, [1], "a"))
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id long, embedding array<float>")
    for write in (c.append, c.upsert, c.insert_ignore):
        with pytest.raises(ValueError):
            write(bad)
        assert _state(c) == [(1, "a")]
    c.upsert(_batch(spark, [1], "b"))
    assert _state(c) == [(1, "b")]
    assert [t.name for t in spark.catalog.listTables(c.database)] == ["c"]  # no staged table is left


def test_write_modes_with_nulls_and_emptied_buckets(spark):
    rows = [(i, None if i % 5 == 0 else [float(i), 1.0], None if i % 3 == 0 else "p") for i in range(60)]
    df = spark.createDataFrame([*rows, (None, [0.0, 1.0], "no id")], "id long, embedding array<double>, image_path string")
    c = Collection(spark, tempfile.mkdtemp(prefix="coll-"), "c", dim=2, n_buckets=4).create()
    c.append(df)
    c.delete_where("image_path = 'p'")  # NULL keeps the row
    assert sorted(r.id for r in c.read().where("id IS NOT NULL").collect()) == list(range(0, 60, 3))
    again = Collection(spark, c.root, "c", dim=2, n_buckets=64).create()  # the buckets it was made with
    again.upsert(df.where("id < 3"))
    assert again.n_buckets == 4 and sorted(r.id for r in c.read().where("id < 6").collect()) == [0, 1, 2, 3]
    c.delete_where("true")
    assert c.read().count() == 0 and c.exists()
    c.upsert(df.where("id = 7"))
    assert _state(c) == [(7, "p")]


def test_own_column_names_are_refused(spark):
    from pyspark.sql import types as T

    with pytest.raises(ValueError):
        Collection(spark, "/unused", "c", dim=2, payload=T.StructType([T.StructField("Bucket", T.IntegerType())]))


def test_stream_upsert_is_idempotent(spark):
    from nearfield.streaming.upsert import run_upsert_stream

    src = tempfile.mkdtemp(prefix="land-")
    b1 = _batch(spark, [1, 2, 3], "first")
    b1.coalesce(1).write.mode("append").parquet(f"{src}/x")
    c = _coll(spark)
    ckpt = tempfile.mkdtemp(prefix="ck-")
    run_upsert_stream(spark, f"{src}/x", b1.schema, c, ckpt, name="s")
    assert _state(c) == [(1, "first"), (2, "first"), (3, "first")]
    run_upsert_stream(spark, f"{src}/x", b1.schema, c, ckpt, name="s")  # nothing new
    assert _state(c) == [(1, "first"), (2, "first"), (3, "first")]
    _batch(spark, [3, 4], "second").coalesce(1).write.mode("append").parquet(f"{src}/x")
    run_upsert_stream(spark, f"{src}/x", b1.schema, c, ckpt, name="s")
    second = [(1, "first"), (2, "first"), (3, "second"), (4, "second")]
    assert _state(c) == second
    c.upsert(b1, stream="s", epoch=0)  # a replay after a later epoch
    assert _state(c) == second
    c.upsert(b1.where("id = 3"), stream="t", epoch=0)  # another stream has epochs of its own
    assert _state(c) == [(1, "first"), (2, "first"), (3, "first"), (4, "second")]


def test_collection_search_request(spark):
    c = _coll(spark)
    c.append(_batch(spark, [1, 2, 3], "p"))
    hits = c.search({0: [2.0, 1.0]}, "pgvector", {"certainty": 0.98, "limit": 10})
    assert sorted(r.id for r in hits.collect()) == [2, 3]  # cos to (2, 1): 0.949, 1.0, 0.990
    with pytest.raises(KeyError):
        c.search({0: [2.0, 1.0]}, "weaviate", {"limit": 1})
