"""Test tables and how the library's concepts map onto them.

* ``embeddings`` is the collection: ``vec_id`` = id, ``embedding``, ``label``
  = class of the item.  Queries are the class prototypes (sum of the member
  vectors of each class), so the query set is derived from the whole table;
  an item is relevant to a query when it has the query's class.
* ``documents`` + ``labels`` are a second labelled collection: documents are
  embedded with the built-in letter profile, ``labels`` is the wide label
  table with two targets (``quality``, ``toxic``); the query of a target is
  the prototype of its positive documents.
* ``pages.url`` gives item paths (``page_id`` = item id).
* ``events`` is a request log: ``event_type`` = store, ``value`` = search
  time, ``event_type <> 'error'`` = success, ``ts`` = completion time, the day
  of ``ts`` = one benchmark run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.text import letter_profile
from nearfield.operators.evaluate import labels_wide_to_long
from nearfield.operators.search import class_prototypes

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed parameters of the registered queries.
THRESHOLD = 0.2  # cosine cut-off on embeddings
LIMIT = 10000  # hits per query
TOPK = 10  # k of the k-NN queries
DOC_THRESHOLD = 0.95  # cosine cut-off on document letter profiles
DOC_TARGETS = ("quality", "toxic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def collection(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def class_queries(coll: DataFrame) -> DataFrame:
    return class_prototypes(coll, "label", "embedding").withColumnRenamed("label", "query_id")


def doc_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", letter_profile("text").alias("embedding")
    )


def doc_labels_long(spark, sf_dir) -> DataFrame:
    return labels_wide_to_long(table(spark, sf_dir, "labels"), "doc_id", list(DOC_TARGETS))


def target_id(col) -> F.Column:
    out = None
    for i, t in enumerate(DOC_TARGETS):
        out = (F.when(col == t, F.lit(i)) if out is None else out.when(col == t, F.lit(i)))
    return out.cast("long")


def target_name(col) -> F.Column:
    out = None
    for i, t in enumerate(DOC_TARGETS):
        out = (F.when(col == i, F.lit(t)) if out is None else out.when(col == i, F.lit(t)))
    return out


def doc_vectors_once(spark, sf_dir) -> DataFrame:
    """Document vectors, computed once and checkpointed (reliable checkpoint in
    the session's checkpoint folder): both the target prototypes and the
    searched collection use them, and they are about 1% of the text size."""
    from nearfield.session import checkpoint_dir

    checkpoint_dir(spark)
    return doc_vectors(spark, sf_dir).checkpoint(eager=True)


def doc_target_queries(spark, sf_dir, vectors: DataFrame | None = None) -> DataFrame:
    """Prototype of the positive documents of each target."""
    pos = doc_labels_long(spark, sf_dir).where(F.col("y_true") == 1).select("doc_id", "target")
    vecs = vectors if vectors is not None else doc_vectors(spark, sf_dir)
    members = pos.join(vecs, "doc_id")
    protos = class_prototypes(members, "target", "embedding")
    return protos.select(target_id(F.col("target")).alias("query_id"), "embedding")
