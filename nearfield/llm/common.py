"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.session import checkpoint_dir, scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Largest Arrow batch handed to a Python worker, in bytes; a longer row goes alone.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does: rows have no bound where texts have any length."""
    unset = str((1 << 31) - 2)
    if spark.conf.get(_BATCH_KEY, unset).rstrip("b") == unset:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands its freed memory back when it ends.

    Workers are reused, and what their allocators keep would add up over the
    stages of a job beside a grown JVM heap.
    """

    @wraps(run)
    def freed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return freed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage of loops."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder once and read it back.

    Later readers see one fixed set of rows (row numbers included), and a lost
    executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the named columns, cast to the types the operator works with."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def documents_like(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` in their order, absent ones null."""
    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType()}
    have = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, T.StringType())).alias(c)
            for c in DOCUMENT_COLUMNS
        ]
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
