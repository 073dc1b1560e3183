"""Filter and refine over one-byte codes (G4 with C2): exact search at a cut-off that reads a quarter of the bytes.

A row's unit vector ``u`` is kept a second time as one signed byte a dimension:
``code = round(u / step)`` with ``step = max|u| / 127``, and with it ``err``,
the length of ``u - step * code``.  For a unit query ``q`` the cosine lies
within ``err`` of ``step * (code . q)``, whatever the data.  A search reads
the codes only, keeps the rows whose bound reaches the cut-off (never fewer
than the hits), then reads the vectors of the parts that hold such rows and
scores them exactly.  Near vectors share a part (signs of seeded hyperplanes),
so a selective search reads few of them.

Rows without a usable vector (null, of another length, null or non-finite
elements, all zero) have no code and are never hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.ann import _write_by_cell, build_lsh
from nearfield.operators.scoring import _BLOCK_ELEMS, _CHUNK_ELEMS, _row_chunks, vector_matrix
from nearfield.operators.search import DEFAULT_QUERY_BROADCAST_BYTES, ScoreRule, _query_block_arrays, _query_blocks, top_per_query
from nearfield.session import scratch_path

#: Room of a bound for rounding in the two products.
_SLACK = 1e-9


@dataclass
class CodeIndex:
    """``data``: the collection's rows with ``code``, ``step``, ``err`` and the part ``cell``; ``dim``: vector length."""

    data: DataFrame
    dim: int


def _units(col, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable rows of a vector column."""
    rows, M = vector_matrix(col, dim)
    size = np.einsum("ij,ij->i", M, M)
    fine = np.isfinite(size) & (size > 0)
    return rows[fine], M[fine] / np.sqrt(size[fine])[:, None]


def build_codes(coll: DataFrame, dim: int, vec_col: str = "embedding", part_bits: int = 6, seed: int = 5) -> CodeIndex:
    """Codes of every row in one pass without a shuffle; ``2 ** part_bits`` parts."""
    data = build_lsh(coll, part_bits, dim, vec_col, seed).data
    for name in ("code", "step", "err"):
        if name in coll.columns:
            raise ValueError(f"the collection already has a column {name!r}")
    schema = T.StructType([*data.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("step", T.DoubleType()), T.StructField("err", T.DoubleType())])

    def encode(batches):
        import pyarrow as pa

        for batch in _row_chunks(batches, max(1, _CHUNK_ELEMS // max(dim, 1))):
            rows, U = _units(batch.column(batch.schema.get_field_index(vec_col)), dim)
            step = np.abs(U).max(axis=1) / 127 if len(U) else np.zeros(0)
            code = np.rint(U / step[:, None]).astype(np.int8)
            off = U - step[:, None] * code
            err = np.sqrt(np.einsum("ij,ij->i", off, off))
            codes, steps, errs = ([None] * batch.num_rows for _ in range(3))
            for at, c, s, e in zip(rows.tolist(), code, step.tolist(), err.tolist(), strict=True):
                codes[at], steps[at], errs[at] = c.tobytes(), s, e
            extra = [pa.array(codes, pa.binary()), pa.array(steps, pa.float64()), pa.array(errs, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "code", "step", "err"])

    return CodeIndex(data.mapInArrow(encode, schema), int(dim))


def save_codes(index: CodeIndex, path: str, vec_col: str = "embedding") -> None:
    """Write the rows in folders by part; codes and vectors are columns that are read apart."""
    _write_by_cell(index.data, path, vec_col)


def load_codes(spark: SparkSession, path: str, dim: int) -> CodeIndex:
    return CodeIndex(spark.read.parquet(path), int(dim))


def code_candidates(index: CodeIndex, query_ids: np.ndarray, units: np.ndarray, cutoff: float, id_col: str) -> DataFrame:
    """(cell, id, queries): rows that may reach the cut-off, with the queries they may reach it for; reads no vector."""
    data = index.data.select("cell", id_col, "code", "step", "err").where("code is not null")
    dim = index.dim
    shared = data.sparkSession.sparkContext.broadcast((query_ids, units))
    schema = T.StructType([data.schema["cell"], data.schema[id_col], T.StructField("queries", T.ArrayType(T.LongType()))])

    def bound(batches):
        import pyarrow as pa

        ids, Q = shared.value
        for batch in _row_chunks(batches, max(1, min(_CHUNK_ELEMS // max(dim, 1), _BLOCK_ELEMS // max(len(ids), 1)))):
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            code = np.frombuffer(b"".join(column["code"].to_pylist()), np.int8).reshape(-1, dim)
            step, err = column["step"].to_numpy(), column["err"].to_numpy()
            best = (code.astype(np.float64) @ Q.T) * step[:, None] + (err + _SLACK)[:, None]
            row, query = np.nonzero(best >= cutoff)
            some, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(ids[query], pa.int64()))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([column["cell"].take(take), column[id_col].take(take), lists], schema=_arrow(schema))

    return data.mapInArrow(bound, schema)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def code_search(
    index: CodeIndex,
    queries: DataFrame,
    *,
    cutoff: float,
    limit: int | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "embedding",
    budget_bytes: int = DEFAULT_QUERY_BROADCAST_BYTES,
) -> DataFrame:
    """``query_id, id, score[, rank]`` of all rows with cosine >= ``cutoff``, as the exact search gives them.

    The query set goes through in blocks of measured size, as in ``search``.
    """
    spark, dim, hits = index.data.sparkSession, index.dim, None
    schema = T.StructType([T.StructField("query_id", T.LongType()), index.data.schema[id_col], T.StructField("score", T.DoubleType())])
    for rows in _query_blocks(queries, query_id_col, query_vec_col, budget_bytes, limit):
        for ids, Q in _query_block_arrays(rows, "cosine"):
            if Q.shape[1] != dim:
                continue
            units = Q / np.linalg.norm(Q, axis=1, keepdims=True)
            path = scratch_path(spark, "code-candidates")
            code_candidates(index, ids, units, cutoff, id_col).write.parquet(path)
            found = spark.read.schema(f"cell int, `{id_col}` {index.data.schema[id_col].dataType.simpleString()}, queries array<long>").parquet(path)
            parts = [r["cell"] for r in found.select("cell").distinct().collect()]  # at most one per part
            # Rows that share an id share their candidates; the exact score decides for each.
            wanted = found.groupBy("cell", id_col).agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))
            vectors = index.data.where(F.col("cell").isin(parts)).select("cell", id_col, vec_col)
            survivors = vectors.join(wanted, ["cell", id_col]).select(id_col, vec_col, "queries")
            scored = survivors.mapInArrow(_refine(spark, ids, units, dim, cutoff, id_col, vec_col, schema), schema)
            hits = scored if hits is None else hits.unionByName(scored)
    if hits is None:
        hits = spark.createDataFrame([], schema)
    return hits if limit is None else top_per_query(hits, ScoreRule("cosine", "identity"), int(limit), id_col)


def _refine(spark, query_ids, units, dim, cutoff, id_col, vec_col, schema):
    """The exact scores of rows with the queries of their candidates."""
    order = np.argsort(query_ids, kind="stable")
    shared = spark.sparkContext.broadcast((query_ids[order], units[order]))
    names = ["query_id", id_col, "score"]

    def refine(batches):
        import pyarrow as pa

        ids, Q = shared.value
        for batch in _row_chunks(batches, max(1, _CHUNK_ELEMS // max(dim, 1))):
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows, U = _units(column[vec_col], dim)
            of = column["queries"].take(pa.array(rows))
            sizes = np.diff(of.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(rows)), sizes)
            asked = of.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            # A query id that is listed twice stands for both of its vectors.
            low, high = np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")
            own = np.repeat(own, high - low)
            at = np.repeat(low - np.cumsum(np.append(0, (high - low)[:-1])), high - low) + np.arange(len(own))
            for cut in range(0, len(own), max(1, _CHUNK_ELEMS // max(dim, 1))):
                o, q = (x[cut : cut + max(1, _CHUNK_ELEMS // max(dim, 1))] for x in (own, at))
                score = np.einsum("ij,ij->i", U[o], Q[q])
                keep = score >= cutoff
                take = pa.array(rows[o[keep]])
                arrays = [pa.array(ids[q[keep]], pa.int64()), column[id_col].take(take), pa.array(score[keep], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names).cast(_arrow(schema))

    return refine


def scanned_bytes(index: CodeIndex, vec_col: str = "embedding") -> DataFrame:
    """(n_rows, code_bytes, vector_bytes): what a pass over the codes reads, and over the vectors as float32."""
    fine = F.col("code").isNotNull()
    return index.data.agg(
        F.count_if(fine).alias("n_rows"),
        F.coalesce(F.sum(F.octet_length("code").cast("long") + F.when(fine, 16)), F.lit(0)).alias("code_bytes"),
        F.coalesce(F.sum(F.when(fine, F.lit(4 * index.dim))).cast("long"), F.lit(0)).alias("vector_bytes"),
    )
