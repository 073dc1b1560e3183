"""Vector collections as catalog tables over partitioned Parquet.

A collection is a managed table of the session's catalog, in a database whose
location is ``root``, partitioned by a hash of the row's id.  Every write is a
plain insert: appends add files, upserts and deletes overwrite only the
partitions they touch (dynamic partition overwrite, from a staged table, so no
plan overwrites what it reads).  With a persistent metastore collections
outlive the session; one writer at a time per collection, as for any Parquet
table.

Vectors are stored as ``array<float>`` or, with ``packed=True``, as
little-endian float32 ``binary`` (half the scan cost for the Arrow scorer).

Write modes of the store adapters map to methods:

* ``append``         - re-inserting duplicates rows (generated or caller ids)
* ``upsert``         - overwrite by id: new rows + old rows whose id is not new
* ``insert_ignore``  - existing ids are left alone: old rows + new ids only
* ``truncate``       - delete all rows, keep the collection
* ``delete_where``   - drop rows matching a predicate (NULL = keep)
* ``drop``           - remove the collection; no error if absent

Rows written by a stream carry its name and epoch.  An epoch replayed after a
restart writes the same rows again, except where a later epoch of the same
stream has written the id since, so replays leave the collection as it is.
"""

from __future__ import annotations

import hashlib
import logging
import uuid
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.scalars import batch_number
from nearfield.functions.vectors import pack_f32, unpack_f32

log = logging.getLogger(__name__)

DEFAULT_BATCH = 500
DEFAULT_BUCKETS = 32
# Columns of the table beside the collection's own.
LOAD_COLUMNS = {"load_stream": "string", "load_epoch": "bigint"}
BUCKET = "bucket"


class Collection:
    """A named collection of (id, embedding, payload...) rows with fixed dim."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        dim: int,
        id_col: str = "id",
        vec_col: str = "embedding",
        payload: T.StructType | None = None,
        packed: bool = False,
        n_buckets: int = DEFAULT_BUCKETS,
    ):
        self.spark = spark
        self.n_buckets = int(n_buckets)
        self.packed = packed
        self.name = name
        self.dim = int(dim)
        self.id_col = id_col
        self.vec_col = vec_col
        self.root = root.rstrip("/")
        self.payload = payload or T.StructType([T.StructField("image_path", T.StringType())])
        clash = {BUCKET, *LOAD_COLUMNS} & {n.lower() for n in self.schema.names}
        if clash:
            raise ValueError(f"column names {sorted(clash)} are the collection's own")
        self.database = "nearfield_" + hashlib.sha1(self.root.encode()).hexdigest()[:16]
        self.table = f"`{self.database}`.`{name}`"

    # -- schema ------------------------------------------------------------
    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(self.id_col, T.LongType(), True),
                T.StructField(
                    self.vec_col, T.BinaryType() if self.packed else T.ArrayType(T.FloatType()), True
                ),
                *self.payload.fields,
            ]
        )

    @property
    def _columns(self) -> list[str]:
        """Column order of the table; the partition column comes last."""
        return [*self.schema.names, *LOAD_COLUMNS, BUCKET]

    def _conform(self, df: DataFrame, order_col: str | None = None) -> DataFrame:
        """Required columns and vector element type, checked on the schema
        before any job; then cast to the collection schema.  A vector of another
        length fails the job that writes it."""
        fields = {f.name: f.dataType for f in df.schema.fields}
        for c in (self.id_col, self.vec_col):
            if c not in fields:
                raise ValueError(f"input lacks required column {c!r}")
        vt = fields[self.vec_col]
        is_packed_in = isinstance(vt, T.BinaryType)
        if not is_packed_in and (
            not isinstance(vt, T.ArrayType)
            or not isinstance(vt.elementType, (T.FloatType, T.DoubleType))
        ):
            raise TypeError(f"{self.vec_col!r} must be array<float|double>, got {vt.simpleString()}")
        cols = [F.col(self.id_col).cast("long").alias(self.id_col)]
        v = F.col(self.vec_col)
        if self.packed:
            v = v if is_packed_in else pack_f32(v)
            n = F.length(v) / 4
        else:
            v = unpack_f32(v) if is_packed_in else v.cast("array<float>")
            n = F.size(v)
        cols.append(F.when(v.isNotNull() & (n != self.dim), F.raise_error(self._wrong_length)).otherwise(v).alias(self.vec_col))
        for f in self.payload.fields:
            cols.append(
                (F.col(f.name) if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
            )
        if order_col and order_col not in self.schema.names:
            cols.append(F.col(order_col))
        return df.select(*cols)

    @property
    def _wrong_length(self) -> str:
        return f"vectors of a length other than {self.dim} in input"

    @contextmanager
    def _checked_write(self):
        """A write job that met a vector of another length raises ``ValueError``; nothing is committed."""
        try:
            yield
        except PySparkException as error:
            if self._wrong_length in str(error):
                raise ValueError(self._wrong_length) from error
            raise

    # -- DDL -------------------------------------------------------------------
    def _create_table(self, table: str) -> None:
        fields = [(f.name, f.dataType.simpleString()) for f in self.schema.fields]
        columns = ", ".join(f"`{n}` {t}" for n, t in [*fields, *LOAD_COLUMNS.items(), (BUCKET, "int")])
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{self.root}'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({BUCKET}) "
            f"TBLPROPERTIES ('n_buckets' = '{self.n_buckets}')"
        )

    def create(self) -> "Collection":
        """B1: create if not exists (an existing collection is kept, with its number of buckets)."""
        self._create_table(self.table)
        self.n_buckets = int(self.spark.sql(f"SHOW TBLPROPERTIES {self.table} ('n_buckets')").first()["value"])
        return self

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def drop(self) -> None:
        """Remove the collection; no error if absent."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, of some buckets (partition pruning) or of all."""
        if not self.exists():
            raise FileNotFoundError(f"collection {self.name!r} does not exist")
        rows = self.spark.table(self.table)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def read(self) -> DataFrame:
        return self._rows().select(*self.schema.names)

    # -- writes ---------------------------------------------------------------
    def _placed(self, df: DataFrame, stream: str | None = None, epoch: int | None = None) -> DataFrame:
        """Rows in the table's column order, with the writer and the bucket."""
        return df.select(
            *self.schema.names,
            F.lit(stream).cast("string").alias("load_stream"),
            F.lit(epoch).cast("bigint").alias("load_epoch"),
            F.pmod(F.xxhash64(self.id_col), F.lit(self.n_buckets)).cast("int").alias(BUCKET),
        )

    @contextmanager
    def _staged(self, rows: DataFrame):
        """``rows`` as a table of their own beside the collection: evaluated once, dropped afterwards."""
        table = f"`{self.database}`.`stage_{uuid.uuid4().hex}`"
        self._create_table(table)
        try:
            with self._checked_write():
                self._insert(rows, table)
            yield self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _insert(self, rows: DataFrame, table: str, overwrite: bool = False) -> None:
        """Insert rows; ``rebalance`` gathers a bucket's rows and splits large buckets by size."""
        rows.select(*self._columns).hint("rebalance", BUCKET).write.insertInto(table, overwrite=overwrite)

    def _replace(self, rows: DataFrame) -> None:
        """``rows`` take the place of what their buckets held; other buckets are not touched."""
        with self._staged(rows) as stage:
            self._insert(stage, self.table, overwrite=True)

    def _buckets(self, stage: DataFrame) -> list[int]:
        """Buckets of a staged input (at most ``n_buckets`` numbers)."""
        found = sorted(r[BUCKET] for r in stage.select(BUCKET).distinct().collect())
        if not found:  # B7
            log.warning("insert of an empty input into %s skipped", self.name)
        return found

    def append(self, df: DataFrame) -> None:
        """Append; re-inserting an id duplicates it."""
        rows = self._placed(self._conform(df))
        self.create()
        if df.isEmpty():  # B7
            log.warning("insert of an empty input into %s skipped", self.name)
            return
        with self._checked_write():
            self._insert(rows, self.table)

    def _one_per_id(self, df: DataFrame, order_col: str | None) -> DataFrame:
        """One row per id: the one with the greatest ``order_col`` (NULLs least),
        or of equal standing, and without an order, the greatest row."""
        names = [c for c in self.schema.names if c != self.id_col]
        rest = F.struct(*names)
        rank = F.struct(F.col(order_col).alias("__o"), rest.alias("__r")) if order_col else rest
        best = df.groupBy(self.id_col).agg(F.max_by(rest, rank).alias("__best"))
        return best.select(self.id_col, *[F.col(f"__best.{c}").alias(c) for c in names])

    def _without(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(ids.select(self.id_col), self.id_col, "left_anti")

    def upsert(
        self, df: DataFrame, order_col: str | None = None, stream: str | None = None, epoch: int | None = None
    ) -> None:
        """Overwrite by id - new rows win; one row per id in the result.

        Of several new rows with one id the newest by ``order_col`` (a column of
        ``df``, not stored) is kept.  Buckets without a new row are not read.
        A row that a later ``epoch`` of the same ``stream`` has written stays.
        """
        new = self._placed(self._one_per_id(self._conform(df, order_col), order_col), stream, epoch)
        self.create()
        with self._staged(new) as stage:
            buckets = self._buckets(stage)
            if not buckets:
                return
            old, fresh = self._rows(buckets), stage
            if stream is not None:
                later = old.where((F.col("load_stream") == stream) & (F.col("load_epoch") > epoch))
                fresh = self._without(stage, later)
            self._replace(self._without(old, fresh).unionByName(fresh))

    def insert_ignore(self, df: DataFrame) -> None:
        """Existing ids are left alone; only new ids are added."""
        new = self._placed(self._one_per_id(self._conform(df), None))
        self.create()
        with self._staged(new) as stage:
            buckets = self._buckets(stage)
            if buckets:
                self._insert(self._without(stage, self._rows(buckets)), self.table)

    def search(self, queries, store: str = "pgvector", params: dict | None = None, **kw):
        """One search request against the collection, in a store's parameter
        vocabulary (see ``search.search_request``)."""
        from nearfield.operators.search import search_request

        return search_request(
            self.read(), queries, store, params, id_col=self.id_col, vec_col=self.vec_col, **kw
        )

    def truncate(self) -> None:
        """Delete all rows, keep the collection."""
        self.spark.sql(f"TRUNCATE TABLE {self.table}")

    def delete_where(self, predicate: str) -> None:
        """Remove rows where the predicate is true; NULL keeps the row.

        Buckets without such a row are not rewritten; one that loses all its
        rows is dropped as a partition.
        """
        gone = F.coalesce(F.expr(predicate), F.lit(False))
        counts = self._rows().groupBy(BUCKET).agg(F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("n"))
        hit = counts.where("gone > 0").collect()  # at most n_buckets rows
        partly = [r[BUCKET] for r in hit if r["gone"] < r["n"]]
        emptied = [r[BUCKET] for r in hit if r["gone"] == r["n"]]
        if partly:
            self._replace(self._rows(partly).where(~gone))
        if emptied:
            parts = ", ".join(f"PARTITION ({BUCKET} = {b})" for b in emptied)
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS {parts}")

    def compact(self, max_files: int = 8) -> None:
        """Rewrite the buckets that are made up of more than ``max_files`` files."""
        files = self._rows().select(BUCKET, F.input_file_name().alias("file")).distinct()
        many = [r[BUCKET] for r in files.groupBy(BUCKET).count().where(F.col("count") > max_files).collect()]
        if many:
            self._replace(self._rows(many))


def with_batches(df: DataFrame, pos_col: str, batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """Request batches of ``batch_size`` rows by 0-based position."""
    return df.withColumn("batch", batch_number(pos_col, batch_size))
