"""Substring deduplication over suffix arrays that are sorted by induction, shard by shard.

A text is a string of UTF-8 bytes; every byte covered by a string of ``length``
bytes that also starts anywhere else (same text included) is removed.

Suffixes are dealt so that equal strings meet.  Each window of ``length`` bytes
has an anchor, the leftmost of its ``GRAM``-byte pieces with the smallest hash;
equal windows have equal anchors at equal offsets.  The windows of one anchor form
a run, a *region* of at most 2 * length bytes.  Anchors are counted before places
travel; an anchor met once in the corpus can hold no repeat.  The regions of the
other anchors are counted by content with map-side sums and go into shards by
anchor, of equal regions two (a third adds nothing).  In each shard the suffix array is built by induced
sorting and the permuted common-prefix array is computed
(``suffix_array.py``): a window is repeated when the common prefix with a
neighbour in the order reaches ``length``.  The marks go back to all texts
that hold the region.

An anchor with more than ``HOT_REGIONS`` different regions (the edge of a passage
that a third of all documents share) is dealt anew by the bytes that
neighbouring windows have in common, in blocks of ``_BLOCK`` offsets and then
one by one, where only equal windows share a key.  Its regions are cut from the
texts with the others and are themselves the texts that the next deal reads.  No
group outgrows a shard, and no window is left out.

The texts are shuffled twice, to the regions to be cut and to the marks; what
shuffles leave on disk goes as each step is written.

Defined results: a null text is empty; a text shorter than ``length`` bytes
keeps all; every row is a document of its own, so a repeated row of ``length``
bytes or more loses its whole text like any other copy, and rows without an id
are documents too; there are no ties, because a string counts wherever it
stands.  Texts of any length are read whole, a few megabytes of windows at a
time.  Only ``doc_id`` and ``text`` are read, so other columns may have any
name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import require, stage_table
from nearfield.llm.suffix_array import common_prefixes, suffix_array
from nearfield.llm.texthash import mix64, segment_hash, slices

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

LENGTH = 400
#: Bytes that an anchor is chosen by, at most; a shorter ``length`` takes half of it.
GRAM = 48
HOT_REGIONS = 1_024
SHARD_BYTES = 768 << 10

_BLOCK = 32
_CHUNK = 1 << 22  # windows handled at once; their positions take 23 bits of a packed minimum
_POSITION = np.uint64((1 << 23) - 1)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_CODES_2 = mix64(_CODES ^ np.uint64(0x5851F42D4C957F2D))

_REGION = "fp long, h2 long, size int, off int, key long, doc_id long, place long"


def _stage(df: DataFrame, name: str) -> DataFrame:
    """``stage_table``; the shuffle files that the table was made from are removed once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return stage_table(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column laid end to end, and the offset of each text and of the end."""
    arr = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima within blocks of that width."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def find_regions(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) of every region, as positions in ``data``.

    Windows lie within one text; a region's windows are neighbours with one anchor.
    """
    gram = min(GRAM, length // 2)
    of_byte = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    found = []
    for c in range(0, max(len(data) - length + 1, 0), _CHUNK):
        part = data[c : c + _CHUNK + length - 1]
        n = len(part) - gram + 1
        codes = _CODES[part]
        grams = segment_hash(codes, np.arange(n), np.arange(n) + gram)
        packed = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
        anchor = (_sliding_min(packed, length - gram + 1) & _POSITION).astype(np.int64)
        text = of_byte[c : c + len(anchor)]
        inside = text == of_byte[c + length - 1 : c + length - 1 + len(anchor)]
        cut = np.ones(len(text), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(cut)
        # Windows that leave their text stand behind those that do not, so a run is cut short at most.
        count = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
        keep = (count > 0) & inside[first]
        first, count = first[keep], count[keep]
        found.append((text[first].astype(np.int64), first + c, count, anchor[first] + c, grams[anchor[first]]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _regions_table(docs: DataFrame, length: int) -> DataFrame:
    """A row per region of every text: anchor hash, content hash, bytes, the anchor's offset, and where it stands."""
    names = [x.split()[0] for x in _REGION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = text_bytes(part.column("text"))
                text, first, count, anchor, fp = find_regions(data, bounds, length)
                if not len(text):
                    continue
                size = count + length - 1
                h2 = segment_hash(_CODES_2[data], first, first + size)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fp.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.array((anchor - first).astype(np.int32)),
                        *(part.column(c).take(rows) for c in ("key", "doc_id")),
                        pa.array(first - bounds[text]),
                    ],
                    names=names,
                )

    return docs.mapInArrow(run, _REGION)


def _split_regions(held: DataFrame, hot: DataFrame, length: int, width: int) -> DataFrame:
    """Regions of hot anchors, ``held`` as texts, cut into runs of ``width`` offsets; their key is what the windows of a run have in common."""
    schema = f"{_REGION}, n long, up_fp long, up_h2 long, up_size int, delta int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = text_bytes(part.column("text"))
                rows: list[tuple] = []
                codes, codes_2 = _CODES[data], _CODES_2[data]
                for i, own in enumerate(part.column("picks").to_pylist()):
                    for p in own:
                        at, last = int(bounds[i]) + p["place"], p["size"] - length
                        for block in range((p["off"] - last) // width, p["off"] // width + 1):
                            top = p["off"] - block * width
                            rows.append((i, at, max(top - width + 1, 0), min(top, last), top, block, p))
                if not rows:
                    continue
                text, at, low, high, top, block = (np.array([r[k] for r in rows], np.int64) for k in range(6))
                parents = [r[6] for r in rows]
                up = np.array([p["fp"] for p in parents], np.int64)
                core = segment_hash(codes, at + top, at + top - width + 1 + length)
                with np.errstate(over="ignore"):
                    fp = mix64(core ^ mix64(up.view(np.uint64) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                size = high - low + length
                h2 = segment_hash(codes_2, at + low, at + low + size)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fp.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.array((block * width + top - low).astype(np.int32)),
                        *(part.column(c).take(take) for c in ("key", "doc_id")),
                        pa.array(at - bounds[text] + low),
                        pa.array([p["n"] for p in parents], pa.int64()),
                        pa.array(up),
                        pa.array([p["h2"] for p in parents], pa.int64()),
                        pa.array([p["size"] for p in parents], pa.int32()),
                        pa.array(low.astype(np.int32)),
                    ],
                    names=names,
                )

    own = hot.filter("copy = 0").withColumns({"key": F.col("fp"), "doc_id": F.col("h2"), "place": F.lit(0).cast("long")})
    return _with_picks(held, own).mapInArrow(run, schema)


def _with_picks(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """Texts that hold picked regions, with the list of them."""
    own = picks.groupBy("key", "doc_id").agg(
        F.collect_list(F.struct("place", "size", "off", "fp", "h2", "copy", "n", "hot")).alias("picks")
    )
    same = (F.col("d.key") == F.col("p.key")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    return docs.alias("d").join(own.alias("p"), same).select("d.key", "d.doc_id", "d.text", "p.picks")


def _repeated_windows(docs: DataFrame, picks: DataFrame, length: int) -> DataFrame:
    """(fp, h2, size, runs, bytes): windows of the picked regions that the suffix array of their shard finds twice.

    ``runs`` lists first and last window of each run, from the start of the region.
    Regions of hot anchors are not sorted; of each one row has its bytes and no runs.
    """
    names = ["fp", "h2", "size", "copy", "hot", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def unsorted(rows: list[tuple]) -> pa.RecordBatch:
        fp, h2, size, _, _, raw = zip(*rows, strict=True)
        return _found(fp, h2, size, [None] * len(rows), raw)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, own in zip(part.column("text").to_pylist(), part.column("picks").to_pylist(), strict=True):
                    rows += [
                        (p["fp"], p["h2"], p["size"], p["copy"], p["hot"], text[p["place"] : p["place"] + p["size"]])
                        for p in own
                        if p["copy"] == 0 or not p["hot"]
                    ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                    )

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_bytes, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] == last:  # the same place once more, from a row listed twice
                    continue
                if held and (row[4] != held[-1][4] or n_bytes >= SHARD_BYTES and (row[4] or row[0] != held[-1][0])):
                    yield unsorted(held) if held[-1][4] else _sort_shard(held, length)
                    held, n_bytes = [], 0
                last = row[:4]
                held.append(row)
                n_bytes += row[2]
        if held:
            yield unsorted(held) if held[-1][4] else _sort_shard(held, length)

    pieces = _with_picks(docs, picks).mapInArrow(cut, "fp long, h2 long, size int, copy int, hot boolean, bytes binary")
    pieces = pieces.repartition("fp", F.when(F.col("hot"), F.col("h2"))).sortWithinPartitions("hot", "fp", "h2", "size", "copy")
    return pieces.mapInArrow(sort_shards, "fp long, h2 long, size int, runs array<int>, bytes binary")


def _found(fp: list, h2: list, size: list, runs: list, raw: list) -> pa.RecordBatch:
    kinds = {"fp": pa.int64(), "h2": pa.int64(), "size": pa.int32(), "runs": pa.list_(pa.int32()), "bytes": pa.binary()}
    columns = zip((fp, h2, size, runs, raw), kinds.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=list(kinds))


def _sort_shard(rows: list[tuple], length: int) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    sizes = np.array([len(r[5]) for r in rows], np.int64)
    order, _ = suffix_array(data, sizes)
    previous, plcp = common_prefixes(data, sizes, order)
    twice = plcp >= length
    twice[previous[twice]] = True
    ends = np.cumsum(sizes)
    out: dict[str, list] = {"fp": [], "h2": [], "size": [], "runs": []}
    for (fp, h2, size, copy, _, _), end in zip(rows, ends, strict=True):
        own = twice[end - size : end - length + 1].astype(np.int8)
        if copy == 0 and own.any():
            step = np.diff(np.concatenate(([0], own, [0])))
            runs = np.stack((np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1), 1).reshape(-1)
            for name, value in zip(out, (fp, h2, size, runs.tolist()), strict=True):
                out[name].append(value)
    return _found(*out.values(), [None] * len(out["fp"]))


def _met_again(regions: DataFrame) -> DataFrame:
    """The ``regions`` whose anchor is met again, by their weight ``n`` per row."""
    met = regions.groupBy("fp").agg(F.sum("n").alias("met")).filter("met > 1").select("fp")
    return _stage(regions.join(_stage(met, "suffix-anchors"), "fp"), "suffix-met")


def _marks(docs: DataFrame, regions: DataFrame, length: int, widths: list[int], hot_regions: int) -> DataFrame:
    """(fp, h2, size, runs) over the kinds of ``regions``, which has a weight ``n`` per row."""
    where = F.struct("key", "place", "doc_id")
    kinds = regions.groupBy("fp", "h2", "size", "off").agg(F.sum("n").alias("n"), F.min(where).alias("lo"), F.max(where).alias("hi"))
    kinds = _stage(kinds, "suffix-kinds")
    if widths:  # a table of its own, so that the contents of one anchor need not meet in a task
        many = kinds.groupBy("fp").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot_regions)
        kinds = kinds.join(_stage(many.select("fp", F.lit(True).alias("many")), "suffix-hot"), "fp", "left")
    hot = F.coalesce("many", F.lit(False)) if widths else F.lit(False)
    copies = F.when(F.col("n") > 1, F.array("lo", "hi")).otherwise(F.array("lo"))
    picks = _stage(
        kinds.select("fp", "h2", "size", "off", "n", hot.alias("hot"), F.posexplode(copies).alias("copy", "at"))
        .select("fp", "h2", "size", "off", "n", "hot", "copy", "at.*"),
        "suffix-picks",
    )
    found = _stage(_repeated_windows(docs, picks, length), "suffix-found")
    marks = found.filter("runs IS NOT NULL").drop("bytes")
    hot = picks.filter("hot")
    if hot.isEmpty():
        return marks
    held = found.filter("runs IS NULL").select(F.col("fp").alias("key"), F.col("h2").alias("doc_id"), F.col("bytes").alias("text"))
    runs = _met_again(_stage(_split_regions(held, hot, length, widths[0]), "suffix-split"))
    inner = _marks(held, runs, length, widths[1:], hot_regions)
    lifted = runs.join(inner, ["fp", "h2", "size"]).select(
        F.col("up_fp").alias("fp"),
        F.col("up_h2").alias("h2"),
        F.col("up_size").alias("size"),
        F.transform("runs", lambda x: x + F.col("delta")).alias("runs"),
    )
    return marks.unionByName(lifted)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """Per document what is left without repeated strings.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed_spans
    (byte ranges ``start:end``, comma-joined); with ``with_bytes`` also
    kept_bytes (binary: a cut may fall inside a character).
    """
    docs = require(docs, {"doc_id": "long", "text": "string"})
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    regions = _met_again(_stage(_regions_table(docs, length), "suffix-regions").withColumn("n", F.lit(1).cast("long")))
    marks = _stage(_marks(docs, regions, length, [_BLOCK, 1], hot_regions), "suffix-marks")
    runs = (
        regions.join(marks, ["fp", "h2", "size"])
        .groupBy("key", "doc_id")
        .agg(F.collect_set(F.struct("place", "runs")).alias("marks"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string"
    schema += ", kept_bytes binary" if with_bytes else ""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [
                    _strip(text, own, length)
                    for text, own in zip(part.column("text").to_pylist(), part.column("marks").to_pylist(), strict=True)
                ]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = [x.split()[0] for x in schema.split(", ")]
                made = [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(made[: len(names)], names=names)

    same = (F.col("d.key") == F.col("r.key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
    return docs.alias("d").join(runs.alias("r"), same, "left").select("d.doc_id", "d.text", "r.marks").mapInArrow(strip, schema)


def _strip(text: bytes | None, marks: list | None, length: int) -> tuple[int, int, int, str, str, bytes]:
    raw = text or b""
    if not marks:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), "", raw
    flat = np.concatenate([np.asarray(m["runs"], np.int64).reshape(-1, 2) + m["place"] for m in marks])
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, flat[:, 0], 1)
    np.add.at(step, flat[:, 1] + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    spans = ",".join(f"{a}:{b}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return len(raw), int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest(), spans, kept
