"""Approximate search that reaches a stated recall, and cell search that stops at a bound.

* ``MultiLSH``: several independent hyperplane tables.  A query reads, in every
  table, the cells that its vector most nearly falls into: a cell that differs
  in some bits costs the sum of the squared distances to the hyperplanes of those
  bits, and cells are probed in order of cost.  A row found in several tables
  counts once.
* ``BoundedIVF``: cells with their reach, the largest angle between a row and the
  cell's centroid.  No row of a cell scores better than the cosine of the query's
  angle to the centroid less the reach, so a query goes on to further cells, best
  bound first, until the bound of the next one is below its ``limit``-th score or
  the cut-off.  The result is exact; on clustered data few cells are read.
* ``tune``: raises a parameter of a search until its recall over a bounded sample
  of queries, against exact search, reaches a target.

Both indexes hold every row, are written partitioned by cell, and read only the
folders of probed cells.  Rows without a usable vector are never hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.ann import IVFIndex, _by_cell, _write_by_cell, load_ivf, recall_at_k, save_ivf
from nearfield.operators.scoring import _CHUNK_ELEMS, _row_chunks, vector_matrix
from nearfield.operators.search import (
    DEFAULT_QUERY_BROADCAST_BYTES,
    ScoreRule,
    _query_block_arrays,
    _query_blocks,
    search,
    top_per_query,
)
from nearfield.session import scratch_path

#: Queries of the sample that ``tune`` measures on.
TUNE_QUERIES = 50
#: Most bits that a probed cell may differ in.
MAX_FLIPS = 4
_SLACK = 1e-9  # of a bound against rounding


# -- several hash tables ----------------------------------------------------------------


@dataclass
class MultiLSH:
    """``planes``: (tables, bits, dim); ``data``: every row once per table, with its ``cell``."""

    planes: np.ndarray
    data: DataFrame

    @property
    def n_tables(self) -> int:
        return self.planes.shape[0]

    @property
    def cells_per_table(self) -> int:
        return 1 << self.planes.shape[1]

    def probes(self, Q: np.ndarray, n_probes: int) -> dict[int, np.ndarray]:
        """Queries by cell: in each table the ``n_probes`` cells of least cost."""
        bits = self.planes.shape[1]
        flips = [f for n in range(min(MAX_FLIPS, bits) + 1) for f in combinations(range(bits), n)]
        masks = np.array([sum(1 << b for b in f) for f in flips])
        chosen = np.zeros((bits, len(flips)))
        for i, f in enumerate(flips):
            chosen[list(f), i] = 1
        n_probes = min(max(int(n_probes), 1), len(flips))
        pairs = []
        unit = Q / np.maximum(np.linalg.norm(Q, axis=1, keepdims=True), 1e-300)
        for table, planes in enumerate(self.planes):
            margin = unit @ (planes / np.linalg.norm(planes, axis=1, keepdims=True)).T
            own = ((margin > 0) * (1 << np.arange(bits))).sum(axis=1)
            order = np.argsort((margin**2) @ chosen, axis=1, kind="stable")[:, :n_probes]
            cells = (own[:, None] ^ masks[order]) + table * self.cells_per_table
            pairs.append((np.repeat(np.arange(len(Q)), n_probes), cells.ravel()))
        return _by_cell(pairs)


def build_multi_lsh(coll: DataFrame, n_tables: int, n_bits: int, dim: int, vec_col: str = "embedding", seed: int = 11) -> MultiLSH:
    """Hyperplanes from ``seed``, no training pass; each row is dealt to one cell of every table."""
    planes = np.random.default_rng(seed).standard_normal((int(n_tables), int(n_bits), int(dim)))
    bc = coll.sparkSession.sparkContext.broadcast(planes)
    schema = T.StructType([*coll.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()), False)])

    def assign(batches):
        import pyarrow as pa

        tables, bits, d = bc.value.shape
        flat = bc.value.reshape(tables * bits, d)
        weights = 1 << np.arange(bits)
        for b in _row_chunks(batches, max(1, _CHUNK_ELEMS // max(d, tables * bits))):
            rows, M = vector_matrix(b.column(b.schema.get_field_index(vec_col)), d)
            cells = np.full((b.num_rows, tables), -1, np.int32)
            if len(rows):
                signs = ((np.nan_to_num(M) @ flat.T) > 0).reshape(len(rows), tables, bits)
                cells[rows] = (signs * weights).sum(axis=2) + np.arange(tables) * (1 << bits)
            offsets = pa.array(np.arange(0, cells.size + 1, tables), pa.int32())
            yield b.append_column("cells", pa.ListArray.from_arrays(offsets, pa.array(cells.ravel())))

    data = coll.mapInArrow(assign, schema).withColumn("cell", F.explode("cells")).drop("cells")
    return MultiLSH(planes, data)


def save_multi_lsh(index: MultiLSH, path: str, vec_col: str = "embedding") -> None:
    """Write the rows in folders by (table, cell), and the hyperplanes."""
    _write_by_cell(index.data, f"{path}/data", vec_col)
    rows = [(t, b, [float(x) for x in p]) for t, table in enumerate(index.planes) for b, p in enumerate(table)]
    planes = index.data.sparkSession.createDataFrame(rows, "tbl int, bit int, plane array<double>")
    planes.coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")


def load_multi_lsh(spark: SparkSession, path: str) -> MultiLSH:
    rows = spark.read.parquet(f"{path}/planes").orderBy("tbl", "bit").collect()  # tables x bits rows
    tables = 1 + max(r["tbl"] for r in rows)
    planes = np.array([r["plane"] for r in rows], np.float64).reshape(tables, len(rows) // tables, -1)
    return MultiLSH(planes, spark.read.parquet(f"{path}/data"))


def multi_lsh_search(
    index: MultiLSH, queries, n_probes: int, *, rule: ScoreRule = ScoreRule(), cutoff=None, limit: int | None = None, id_col: str = "id", **kw
) -> DataFrame:
    """Union of the tables' hits, each row once; a row can be met once per table, so that many times the limit is kept until then."""
    wide = None if limit is None else int(limit) * index.n_tables
    hits = search(
        index.data, queries, rule=rule, cutoff=cutoff, limit=wide, id_col=id_col, probe_fn=lambda Q: index.probes(Q, n_probes), cell_col="cell", **kw
    )
    hits = hits.dropDuplicates(["query_id", id_col])
    return hits if limit is None else top_per_query(hits.drop("rank"), rule, int(limit), id_col)


# -- cells with a bound -----------------------------------------------------------------


@dataclass
class BoundedIVF:
    index: IVFIndex
    reach: np.ndarray  # (n_cells,) largest angle of a row to its centroid; -1 for a cell without rows

    def bounds(self, Q: np.ndarray) -> np.ndarray:
        """Best cosine that a row of each cell can have with each query; -inf for empty cells."""
        unit = Q / np.maximum(np.linalg.norm(Q, axis=1, keepdims=True), 1e-300)
        angle = np.arccos(np.clip(unit @ self.index.centroids.T, -1.0, 1.0))
        best = np.cos(np.maximum(angle - self.reach, 0.0)) + _SLACK
        return np.where(self.reach < 0, -np.inf, best)


def with_reach(index: IVFIndex, vec_col: str = "embedding") -> BoundedIVF:
    """Measure the reach of every cell in one pass (one row per cell reaches the driver)."""
    bc = index.data.sparkSession.sparkContext.broadcast(index.centroids)

    def angles(batches):
        import pyarrow as pa

        C = bc.value
        for b in _row_chunks(batches, max(1, _CHUNK_ELEMS // C.shape[1])):
            rows, M = vector_matrix(b.column(0), C.shape[1])
            cell = b.column(1).to_numpy(zero_copy_only=False)[rows]
            norm = np.sqrt(np.einsum("ij,ij->i", M, M))
            ok = np.isfinite(norm) & (norm > 0)
            cosine = np.einsum("ij,ij->i", M[ok], C[cell[ok]]) / norm[ok]
            least: dict[int, float] = {}
            for c in np.unique(cell[ok]):
                least[int(c)] = float(cosine[cell[ok] == c].min())
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64())], names=["cell", "least"])

    found = index.data.select(vec_col, "cell").mapInArrow(angles, "cell int, least double").groupBy("cell").agg(F.min("least").alias("least"))
    reach = np.full(index.n_cells, -1.0)
    for r in found.collect():
        reach[r["cell"]] = float(np.arccos(np.clip(r["least"], -1.0, 1.0))) + _SLACK
    return BoundedIVF(index, reach)


def save_bounded(b: BoundedIVF, path: str, vec_col: str = "embedding") -> None:
    save_ivf(b.index, path, vec_col)
    rows = [(i, float(x)) for i, x in enumerate(b.reach)]
    b.index.data.sparkSession.createDataFrame(rows, "cell int, reach double").coalesce(1).write.mode("overwrite").parquet(f"{path}/reach")


def load_bounded(spark: SparkSession, path: str) -> BoundedIVF:
    rows = spark.read.parquet(f"{path}/reach").orderBy("cell").collect()  # n_cells rows
    return BoundedIVF(load_ivf(spark, path), np.array([r["reach"] for r in rows]))


def bounded_search(
    b: BoundedIVF,
    queries: DataFrame,
    *,
    rule: ScoreRule = ScoreRule(),
    cutoff: float | None = None,
    limit: int | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    first_cells: int = 1,
    budget_bytes: int = DEFAULT_QUERY_BROADCAST_BYTES,
    probed: list | None = None,
    **kw,
) -> DataFrame:
    """Exact cosine search that reads cells in order of their bound.

    Each round reads the next cells of the queries that are not done, twice as
    many as the last one, and writes the best hits so far; the rounds are at most
    the logarithm of the cell count.  ``probed`` collects the number of (query,
    cell) pairs read.
    """
    if rule.metric != "cosine":
        raise ValueError("the bound holds for cosine")
    if cutoff is None and limit is None:
        raise ValueError("a search needs a cutoff or a limit")
    spark = b.index.data.sparkSession
    least = -np.inf if cutoff is None else rule.cosine_cutoff(cutoff)
    parts = []
    for rows in _query_blocks(queries, "query_id", vec_col, budget_bytes, limit):
        for ids, Q in _query_block_arrays(rows, "cosine"):
            vectors = {int(i): q for i, q in zip(ids, Q, strict=True)}
            best = b.bounds(Q)
            order = np.argsort(-best, axis=1, kind="stable")
            need = np.full(len(ids), least)
            at, width, top = 0, max(int(first_cells), 1), None
            while at < b.index.n_cells:
                cells = order[:, at : at + width]
                open_ = np.take_along_axis(best, cells, axis=1) >= np.maximum(need, -2.0)[:, None]
                if not open_.any():
                    break
                row, place = np.nonzero(open_)
                if probed is not None:
                    probed.append(len(row))
                plan = _by_cell([(row, cells[row, place])])
                hits = search(
                    b.index.data, vectors, rule=rule, cutoff=cutoff, limit=limit, id_col=id_col, vec_col=vec_col,
                    probe_fn=lambda _, plan=plan: plan, cell_col="cell", budget_bytes=budget_bytes, **kw,
                )
                hits = hits.drop("rank")
                top = hits if top is None else top.unionByName(hits)
                if limit is not None:
                    top = top_per_query(top, rule, int(limit), id_col)
                path = scratch_path(spark, "bounded-hits")
                top.write.parquet(path)
                top = spark.read.parquet(path)
                if limit is not None:
                    last = {r["query_id"]: r["score"] for r in top.filter(F.col("rank") == int(limit)).select("query_id", "score").collect()}
                    for i, q in enumerate(ids.tolist()):  # at most one row per query of the block
                        if q in last:
                            need[i] = max(need[i], rule.cosine_cutoff(last[q]))
                    top = top.drop("rank")
                at, width = at + width, width * 2
            if top is not None:
                parts.append(top)
    if not parts:
        return search(b.index.data, {}, rule=rule, cutoff=cutoff, limit=limit, id_col=id_col, vec_col=vec_col, **kw)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits if limit is None else top_per_query(hits, rule, int(limit), id_col)


# -- recall -----------------------------------------------------------------------------


def pooled_recall(approx: DataFrame, exact: DataFrame, id_col: str) -> tuple[int, int]:
    """(found, all) hits of exact search over all queries."""
    r = recall_at_k(approx, exact, id_col).agg(F.sum("found").alias("found"), F.sum("k").alias("k")).first()
    return int(r["found"] or 0), int(r["k"] or 0)


def tune(run: Callable[[DataFrame, int], DataFrame], exact: Callable[[DataFrame], DataFrame], queries: DataFrame, values: Iterable[int], id_col: str, target: float = 0.95) -> int:
    """The first of ``values`` whose recall over a sample of at most TUNE_QUERIES queries reaches ``target`` (the last if none does)."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNE_QUERIES)
    rows = [tuple(r) for r in sample.collect()]
    sample = queries.sparkSession.createDataFrame(rows, queries.schema)
    path = scratch_path(queries.sparkSession, "tune-exact")
    exact(sample).write.parquet(path)
    want = queries.sparkSession.read.parquet(path)
    value = None
    for value in values:
        found, k = pooled_recall(run(sample, value), want, id_col)
        if found >= target * k:
            break
    if value is None:
        raise ValueError("no values to tune over")
    return value
