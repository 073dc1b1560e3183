"""Distributed embedding extraction (H1-H4).

``extract_embeddings`` runs a caller-supplied embedder over an item table
with ``mapInArrow``: the embedder factory is called once per task (the model
is loaded once per Python worker, not per row), each item yields 0..n
vectors (a flat map), and an item that fails yields one error row instead of
failing the job (H3).  ``split_ok`` separates vectors from the error side
table.  Items are spread by the scan's partitioning; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.text import _LUT

# Items given to a batch embedder at once.
EMBED_BATCH = 64

# An embedder maps one item (e.g. image bytes, text) to 0..n vectors.
Embedder = Callable[[object], Iterable[Iterable[float]]]

# A batch embedder maps a list of payloads to, for each, its parts
# [(part_no or None, vector), ...] or the exception that it failed with.
BatchEmbedder = Callable[[list], list]


def one_by_one(embedder_factory: Callable[[], Embedder]) -> Callable[[], BatchEmbedder]:
    """A batch embedder that calls an item embedder for each payload."""

    def factory() -> BatchEmbedder:
        embed = embedder_factory()

        def many(payloads: list) -> list:
            out = []
            for payload in payloads:
                try:
                    out.append(list(embed(payload)))
                except Exception as e:  # noqa: BLE001 - H3: record, continue
                    out.append(e)
            return out

        return many

    return factory


def extract_embeddings(
    items: DataFrame,
    embedder_factory: Callable[[], Embedder] | None,
    id_col: str,
    payload_col: str,
    carry: tuple[str, ...] | list[str] = (),
    batch_embedder_factory: Callable[[], BatchEmbedder] | None = None,
) -> DataFrame:
    """Flat-map items to (item_id, part_no, embedding, error, *carry).

    ``item_id`` has the type of ``id_col`` (numbers, paths, ...).  A model that
    takes many items at once is given as ``batch_embedder_factory``; it is
    called with up to ``EMBED_BATCH`` payloads.  A batch that raises as a whole
    gives an error row for each of its items.  ``carry`` columns of the item
    (e.g. its source folder) are repeated on each of its rows, so no join back
    to the items is needed - a join on ``item_id`` would put all parts of one
    huge item on one task.
    """
    carry = tuple(carry)
    factory = batch_embedder_factory or one_by_one(embedder_factory)
    schema = T.StructType(
        [
            T.StructField("item_id", items.schema[id_col].dataType, True),
            T.StructField("part_no", T.LongType(), True),
            T.StructField("embedding", T.ArrayType(T.FloatType()), True),
            T.StructField("error", T.StringType(), True),
            *[items.schema[c] for c in carry],
        ]
    )

    def run(batches):
        import pyarrow as pa

        embed = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_BATCH):
                part = batch.slice(at, EMBED_BATCH)
                payloads = part.column(payload_col).to_pylist()
                try:
                    found = embed(payloads)
                except Exception as e:  # noqa: BLE001 - H3: record, continue
                    found = [e] * len(payloads)
                src, numbers, errors, vectors = [], [], [], []
                for pos, out in enumerate(found):
                    if isinstance(out, Exception):
                        src.append(pos)
                        numbers.append(None)
                        vectors.append(None)
                        errors.append(f"{type(out).__name__}: {out}")
                        continue
                    for k, (part_no, v) in enumerate(out):
                        src.append(pos)
                        numbers.append(k if part_no is None else int(part_no))
                        vectors.append(np.asarray(v, dtype=np.float32))
                        errors.append(None)
                if not src:
                    continue
                offsets = np.zeros(len(src) + 1, dtype=np.int32)
                np.cumsum([0 if v is None else len(v) for v in vectors], out=offsets[1:])
                full = [v for v in vectors if v is not None]
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets),
                    pa.array(np.concatenate(full) if full else np.zeros(0, np.float32)),
                    mask=pa.array([v is None for v in vectors]),
                )
                rows = pa.array(src)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col).take(rows),
                        pa.array(numbers, pa.int64()),
                        lists,
                        pa.array(errors, pa.string()),
                        *[part.column(c).take(rows) for c in carry],
                    ],
                    names=["item_id", "part_no", "embedding", "error", *carry],
                )

    cols = [id_col, payload_col, *[c for c in carry if c not in (id_col, payload_col)]]
    return items.select(*dict.fromkeys(cols)).mapInArrow(run, schema)


def split_ok(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and the error side table.  Each side is a plan over ``extracted``:
    use ``write_split`` when both are needed, so the model runs once."""
    ok = extracted.where(F.col("error").isNull()).drop("error")
    bad = extracted.where(F.col("error").isNotNull()).select("item_id", "error")
    return ok, bad


def write_split(extracted: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the tagged rows once, by side, and read both sides back."""
    spark = extracted.sparkSession
    tagged = extracted.withColumn("failed", F.col("error").isNotNull())
    tagged.write.partitionBy("failed").parquet(path)
    schema = T.StructType([*extracted.schema.fields, T.StructField("failed", T.BooleanType())])
    back = spark.read.schema(schema).parquet(path)
    ok = back.where(~F.col("failed")).drop("error", "failed")
    return ok, back.where("failed").select("item_id", "error")


def first_parts(extracted_ok: DataFrame, items: DataFrame | None = None, id_col: str = "item_id"):
    """A10: the first part (lowest ``part_no``) of every item, as the item's
    query vector; ``min_by`` is a partial aggregate, so an item with very
    many parts is reduced map-side.  With ``items``, also returns the items
    that have no part at all (an error for a query image)."""
    first = extracted_ok.groupBy("item_id").agg(
        F.min_by(F.struct("part_no", "embedding"), "part_no").alias("__f")
    ).select("item_id", "__f.part_no", "__f.embedding")
    if items is None:
        return first
    missing = items.select(F.col(id_col).alias("item_id")).join(first, "item_id", "left_anti")
    return first, missing


class NoFaceFound(ValueError):
    """Item without any embeddable part (the source prints and continues)."""


def line_letter_embedder(max_lines: int | None = None) -> Embedder:
    """Example embedder for text items: every non-empty line is one part, its
    vector the letter profile of the line; a text with no letters at all, or
    with more than ``max_lines`` lines, is an error.  Yields (line_no, vector)
    with 0-based line numbers."""
    def embed(text):
        if text is None:
            raise NoFaceFound("empty item")
        if max_lines is not None and text.count("\n") >= max_lines:
            raise NoFaceFound("too many lines in item")
        out = []
        for i, line in enumerate(text.split("\n")):
            if not line:
                continue
            raw = np.frombuffer(line.encode("utf-8"), dtype=np.uint8)
            seg = _LUT[raw]
            v = np.bincount(seg[seg >= 0], minlength=26).astype(np.float64)
            out.append((i, v))
        if not out or sum(float(v.sum()) for _, v in out) == 0:
            raise NoFaceFound("no letters in item")
        return out

    return embed
