"""Approximate search: inverted-file (IVF) cells.

The stores' graph indexes are replaced by a partitioning of the collection:

* ``build_ivf``: Spark ML ``KMeans`` (cosine distance, distributed training)
  learns ``n_cells`` centroids; every row gets the cell of its nearest
  centroid (the centroid matrix, ``n_cells x dim``, is the broadcast side).
  Writing the indexed collection ``partitionBy("cell")`` makes cell pruning a
  directory listing.
* ``ivf_search``: each query probes its ``nprobe`` nearest cells; the scan
  keeps only probed cells (partition pruning when the index is written) and
  the Arrow scorer scores a pair only if the row's cell is probed by that
  query.  ``nprobe = n_cells`` is exact search.

No step groups rows by cell, so a cell holding a third of the collection is
just more partitions of the scan, not one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import sq_norm, unpack_f32
from nearfield.operators.scoring import _CHUNK_ELEMS, _row_chunks, vector_matrix
from nearfield.operators.search import ScoreRule, search

# Rows of one file of a written index.
ROWS_PER_FILE = 250_000


@dataclass
class IVFIndex:
    centroids: np.ndarray  # (n_cells, dim), unit norm
    data: DataFrame  # collection rows + ``cell``
    counts: np.ndarray | None = None  # rows per cell (n_cells,)

    @property
    def n_cells(self) -> int:
        return int(self.centroids.shape[0])

    def nearest_cells(self, Q: np.ndarray):
        """Yield (first query, cells int[rows, n_cells] nearest first), a bounded slice of queries at a time."""
        step = max(1, _CHUNK_ELEMS // max(self.n_cells, 1))
        for at in range(0, len(Q), step):
            part = Q[at : at + step]
            unit = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300)
            yield at, np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")

    def probes(self, Q: np.ndarray, nprobe: int) -> dict[int, np.ndarray]:
        """Queries by cell: each query probes its ``nprobe`` nearest cells."""
        k = min(max(int(nprobe), 1), self.n_cells)
        pairs = [(at + np.repeat(np.arange(len(o)), k), o[:, :k].ravel()) for at, o in self.nearest_cells(Q)]
        return _by_cell(pairs)

    def probes_for_candidates(self, Q: np.ndarray, num_candidates: int) -> dict[int, np.ndarray]:
        """Queries by cell: each query probes its nearest cells that hold ``num_candidates``
        rows (the candidate pool of a k-NN request)."""
        if self.counts is None:
            raise ValueError("index has no cell counts; rebuild or reload it")
        pairs = []
        for at, order in self.nearest_cells(Q):
            cum = np.cumsum(self.counts[order], axis=1)
            # a cell is probed while the rows of the nearer cells are still short
            need = np.concatenate([np.zeros((len(order), 1)), cum[:, :-1]], axis=1) < int(num_candidates)
            row, place = np.nonzero(need)
            pairs.append((at + row, order[row, place]))
        return _by_cell(pairs)


def _by_cell(pairs) -> dict[int, np.ndarray]:
    """[(queries, cells), ...] -> {cell: its queries}."""
    if not pairs:
        return {}
    query, cell = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(cell, kind="stable")
    cells, first = np.unique(cell[order], return_index=True)
    return {int(c): q for c, q in zip(cells, np.split(query[order], first[1:]))}


def _assign_cells(df: DataFrame, centroids: np.ndarray, vec_col: str) -> DataFrame:
    """Nearest centroid of each row, computed per Arrow batch (no shuffle)."""
    sc = df.sparkSession.sparkContext
    bc = sc.broadcast(centroids)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType(), False)])

    def assign(batches):
        import pyarrow as pa

        C = bc.value
        d = C.shape[1]
        for b in _row_chunks(batches, max(1, _CHUNK_ELEMS // max(d, 1))):
            rows, M = vector_matrix(b.column(b.schema.get_field_index(vec_col)), d)
            cell = np.full(b.num_rows, -1, dtype=np.int32)
            if len(rows):
                cell[rows] = np.argmax(np.nan_to_num(M) @ C.T, axis=1).astype(np.int32)
            yield b.append_column("cell", pa.array(cell))

    return df.mapInArrow(assign, schema)


def build_ivf(
    coll: DataFrame,
    n_cells: int,
    vec_col: str = "embedding",
    seed: int = 7,
    max_iter: int = 20,
    centroids: np.ndarray | None = None,
) -> IVFIndex:
    """Train cells with Spark ML KMeans (cosine), or take the given ``centroids``,
    and assign every row."""
    if centroids is not None:
        C = np.asarray(centroids, dtype=np.float64)
        C = C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), 1e-300)
        return IVFIndex(C, _assign_cells(coll, C, vec_col))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # Cosine KMeans normalises internally; zero and NULL vectors are left out
    # (cosine is undefined for them).  Packed vectors are unpacked in their
    # own projection (a Python UDF may not sit inside a lambda).
    vec = F.col(vec_col)
    if isinstance(coll.schema[vec_col].dataType, T.BinaryType):  # packed float32
        vec = unpack_f32(vec)
    arr = coll.select(vec.cast("array<double>").alias("__a"))
    train = arr.where(sq_norm("__a") > 0).select(array_to_vector("__a").alias("features"))
    km = KMeans(k=int(n_cells), seed=seed, maxIter=max_iter, distanceMeasure="cosine")
    model = km.fit(train)
    C = np.vstack([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    C = C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), 1e-300)
    return IVFIndex(C, _assign_cells(coll, C, vec_col))


def cell_counts(index: IVFIndex) -> np.ndarray:
    """Rows per cell (one count per cell reaches the driver)."""
    counts = np.zeros(index.n_cells, dtype=np.int64)
    for r in index.data.groupBy("cell").count().collect():
        if r["cell"] is not None and r["cell"] >= 0:
            counts[int(r["cell"])] = int(r["count"])
    return counts


@dataclass
class LSHIndex:
    """Random-hyperplane LSH: the cell of a vector is its ``n_bits``-bit sign
    signature; a query probes every cell within a Hamming radius of its own."""

    hyperplanes: np.ndarray  # (n_bits, dim)
    data: DataFrame  # collection rows + ``cell``

    @property
    def n_cells(self) -> int:
        return 1 << int(self.hyperplanes.shape[0])

    def signatures(self, M: np.ndarray) -> np.ndarray:
        bits = (M @ self.hyperplanes.T) > 0
        return (bits * (1 << np.arange(bits.shape[1]))).sum(axis=1)

    def probes(self, Q: np.ndarray, radius: int) -> dict[int, np.ndarray]:
        """Queries by cell: each query probes the cells within ``radius`` bit flips of its own."""
        sig = self.signatures(Q)
        bits = range(self.hyperplanes.shape[0])
        flips = [sum(1 << b for b in f) for n in range(min(int(radius), len(bits)) + 1) for f in combinations(bits, n)]
        return _by_cell([(np.arange(len(sig)), sig ^ flip) for flip in flips])


def _assign_signatures(df: DataFrame, planes: np.ndarray, vec_col: str) -> DataFrame:
    sc = df.sparkSession.sparkContext
    bc = sc.broadcast(planes)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType(), False)])

    def assign(batches):
        import pyarrow as pa

        H = bc.value
        weights = 1 << np.arange(H.shape[0])
        for b in _row_chunks(batches, max(1, _CHUNK_ELEMS // max(H.shape[1], 1))):
            rows, M = vector_matrix(b.column(b.schema.get_field_index(vec_col)), H.shape[1])
            cell = np.full(b.num_rows, -1, dtype=np.int32)
            if len(rows):
                cell[rows] = (((np.nan_to_num(M) @ H.T) > 0) * weights).sum(axis=1).astype(np.int32)
            yield b.append_column("cell", pa.array(cell))

    return df.mapInArrow(assign, schema)


def build_lsh(coll: DataFrame, n_bits: int, dim: int, vec_col: str = "embedding", seed: int = 7):
    """Random hyperplanes from ``seed`` (no training pass); every row gets its
    signature cell in one map-only pass."""
    planes = np.random.default_rng(seed).standard_normal((int(n_bits), int(dim)))
    return LSHIndex(planes, _assign_signatures(coll, planes, vec_col))


def lsh_search(index: LSHIndex, queries: DataFrame, radius: int, **kw) -> DataFrame:
    """Search the cells within ``radius`` bit flips of each query's signature;
    candidates are scored exactly.  ``radius = n_bits`` is exact search."""
    return search(
        index.data,
        queries,
        probe_fn=lambda Q: index.probes(Q, radius),
        cell_col="cell",
        **kw,
    )


def _write_by_cell(data: DataFrame, path: str, vec_col: str) -> dict[int, int]:
    """Write rows in folders by cell and return the rows per cell.

    A cell's rows go to as many tasks as its size needs (a hash of the vector
    deals them), so a cell with a third of all rows is neither one task nor a
    file per scan task.
    """
    counts = {int(r["cell"]): int(r["count"]) for r in data.groupBy("cell").count().collect()}
    if counts:
        cells = sorted(counts)
        files = F.array(*[F.lit(max(1, -(-counts[c] // ROWS_PER_FILE))) for c in cells])
        place = F.array_position(F.array(*[F.lit(c) for c in cells]), F.col("cell")).cast("int")
        salt = F.pmod(F.xxhash64(vec_col), F.element_at(files, place))
        total = sum(max(1, -(-n // ROWS_PER_FILE)) for n in counts.values())
        data = data.withColumn("__salt", salt).repartition(total, "cell", "__salt").drop("__salt")
    data.write.mode("overwrite").partitionBy("cell").parquet(path)
    return counts


def save_ivf(index: IVFIndex, path: str, vec_col: str = "embedding") -> None:
    """Write the indexed collection partitioned by cell, plus the centroids
    and rows per cell.  Probing then reads only the probed cells' folders."""
    spark = index.data.sparkSession
    counts = _write_by_cell(index.data, f"{path}/data", vec_col)
    rows = [(i, [float(x) for x in c], counts.get(i, 0)) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, n_rows long").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/centroids")


def save_lsh(index: LSHIndex, path: str, vec_col: str = "embedding") -> None:
    """Write the hashed collection partitioned by signature, plus the hyperplanes."""
    spark = index.data.sparkSession
    _write_by_cell(index.data, f"{path}/data", vec_col)
    rows = [(i, [float(x) for x in h]) for i, h in enumerate(index.hyperplanes)]
    spark.createDataFrame(rows, "bit int, plane array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")


def load_lsh(spark, path: str) -> LSHIndex:
    """Read an index written by ``save_lsh`` (hyperplanes: n_bits rows)."""
    planes = spark.read.parquet(f"{path}/planes").orderBy("bit").collect()
    return LSHIndex(np.array([r["plane"] for r in planes], dtype=np.float64), spark.read.parquet(f"{path}/data"))


def load_ivf(spark, path: str) -> IVFIndex:
    """Read an index written by ``save_ivf`` (centroids: n_cells rows)."""
    cents = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    C = np.vstack([np.asarray(r["centroid"], dtype=np.float64) for r in cents])
    counts = np.asarray([int(r["n_rows"]) for r in cents], dtype=np.int64)
    return IVFIndex(C, spark.read.parquet(f"{path}/data"), counts)


def ivf_search(
    index: IVFIndex,
    queries: DataFrame,
    nprobe: int | None = None,
    *,
    num_candidates: int | None = None,
    rule: ScoreRule = ScoreRule(),
    cutoff: float | None = None,
    limit: int | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    carry=(),
    **kw,
) -> DataFrame:
    """Search only the ``nprobe`` nearest cells of each query, or (with
    ``num_candidates``) the nearest cells holding that many rows."""
    if num_candidates is not None:
        if index.counts is None:
            index.counts = cell_counts(index)
        probe = lambda Q: index.probes_for_candidates(Q, num_candidates)
    else:
        probe = lambda Q: index.probes(Q, nprobe)
    return search(
        index.data,
        queries,
        rule=rule,
        cutoff=cutoff,
        limit=limit,
        id_col=id_col,
        vec_col=vec_col,
        carry=carry,
        probe_fn=probe,
        cell_col="cell",
        **kw,
    )


def recall_at_k(approx: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """Per query: |approx top-k ∩ exact top-k| / |exact top-k|."""
    a = approx.select("query_id", id_col).withColumn("__a", F.lit(1))
    e = exact.select("query_id", id_col)
    j = e.join(a, ["query_id", id_col], "left")
    return j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.count("__a").alias("found"),
    ).withColumn("recall", F.col("found") / F.col("k"))
