"""File listing and selection (A6, A7), packed vectors, report label helpers (F8)."""

import os
import tempfile

from pyspark.sql import functions as F

from nearfield.functions import scalars as S
from nearfield.functions.vectors import pack_f32, unpack_f32
from nearfield.operators.collection import Collection
from nearfield.operators.search import search
from nearfield.sources import files as FS


def _touch(root, rel):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(b"x")
    return p


def test_recursive_listing_with_case_insensitive_suffixes(spark):
    root = tempfile.mkdtemp(prefix="imgs-")
    for rel in ("a/man.JPG", "a/b/woman.jpeg", "c.Png", "notes.txt", "a/b/c/d.gif", "e.bmp.bak"):
        _touch(root, rel)
    names = sorted(r.path.rsplit("/", 1)[-1] for r in FS.list_files(spark, root).collect())
    assert names == ["c.Png", "d.gif", "man.JPG", "woman.jpeg"]


def test_result_file_selection_sorted(spark):
    root = tempfile.mkdtemp(prefix="res-")
    for rel in ("vector_search_results_b.csv", "vector_search_results_a.csv",
                "vector_storing_and_deletion_results__size_3.csv", "vector_search_results_c.txt"):
        _touch(root, rel)
    files = spark.read.format("binaryFile").load(root).select("path")
    got = [r.file_name for r in FS.select_result_files(files, "vector_search_results").collect()]
    assert got == ["vector_search_results_a.csv", "vector_search_results_b.csv"]


def test_pack_roundtrip_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0, 3.25]), (2, None), (3, [])], "id long, v array<float>")
    out = {r.id: r.u for r in df.select("id", unpack_f32(pack_f32("v")).alias("u")).collect()}
    assert out == {1: [1.5, -2.0, 3.25], 2: None, 3: []}


def test_packed_collection_search_equals_array(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    c = Collection(spark, tempfile.mkdtemp(prefix="pk-"), "p", dim=64, packed=True).create()
    c.append(e)
    stored = c.read()
    assert dict(stored.dtypes)["embedding"] == "binary"
    q = e.where("id < 4").select(F.col("id").alias("query_id"), "embedding")
    a = sorted((r.query_id, r.id, round(r.score, 9)) for r in search(e, q, cutoff=0.15, limit=50).collect())
    b = sorted((r.query_id, r.id, round(r.score, 9)) for r in search(stored, q, cutoff=0.15, limit=50).collect())
    assert a == b and len(a) > 4


def test_report_labels(spark):
    r = spark.range(1).select(
        S.capitalize(F.lit("search_TIME")).alias("c"), S.two_decimals(F.lit(3.14159)).alias("t")
    ).first()
    assert (r.c, r.t) == ("Search_time", "3.14")


def test_ivf_on_packed_collection(spark):
    from nearfield.operators.ann import build_ivf, ivf_search, load_ivf, save_ivf

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    packed = e.select("id", pack_f32("embedding").alias("embedding"))
    path = tempfile.mkdtemp(prefix="ivf-")
    save_ivf(build_ivf(packed, 4, max_iter=5), path)
    index = load_ivf(spark, path)
    q = e.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    full = sorted((r.query_id, r.id) for r in ivf_search(index, q, 4, limit=10).collect())
    exact = sorted((r.query_id, r.id) for r in search(e, q, limit=10).collect())
    assert full == exact


def test_packed_queries_and_sql_guard(spark):
    import pytest

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    packed = e.select("id", pack_f32("embedding").alias("embedding"))
    q = e.where("id < 2").select(F.col("id").alias("query_id"), "embedding")
    qp = q.select("query_id", pack_f32("embedding").alias("embedding"))
    a = sorted((r.query_id, r.id) for r in search(e, q, limit=5).collect())
    b = sorted((r.query_id, r.id) for r in search(packed, qp, limit=5).collect())
    assert a == b
    with pytest.raises(ValueError):
        search(packed, q, method="sql")


def test_read_files_of_nested_folders(spark):
    root = tempfile.mkdtemp(prefix="files-")
    for rel, content in [("a/x.TXT", b"one\ntwo"), ("a/b/y.txt", b""), ("a/b/z.bin", b"three"), ("w.txt", b"\xff\x00")]:
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as f:
            f.write(content)
    got = {r.path.rsplit("/", 1)[1]: (r.source_dir, r.length, bytes(r.content)) for r in FS.read_files(spark, root, (".txt",)).collect()}
    folder = os.path.basename(root)  # the empty file is not listed
    assert got == {"x.TXT": ("a", 7, b"one\ntwo"), "w.txt": (folder, 2, b"\xff\x00")}
