"""Mixing sources to target weights.

The words of a source form streams of documents that are cut into blocks of
``BLOCK`` words.  Output shards hold ``SHARD_SLOTS`` slots each; a multinomial
draw, seeded by the shard's number, says how many slots of the shard each
source fills.  The slots of a source are numbered through all shards and mapped
through pseudorandom permutations of its block indices, a new one for every
pass over the source; blocks are then joined by index.

Draws leave the total of a source a little off its share.  Slots past the
share are dealt, one for one, to the sources below theirs, so every source
fills exactly the slots its target asks for, and no block is used more than
three times.

Long sources never meet in one task: a source is parted into streams of
about ``STREAM_DOCS`` documents by a hash, and blocks are numbered through the
streams.  What the driver holds is one row per source.

Defined results: a null text has size 0; a null source is a source of its
own, last in order; documents of size 0 get ``taken`` 0; repeated rows are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import DOCUMENT_COLUMNS, bounded_batches, documents_like, freeing, require, stage_table
from nearfield.llm.texthash import mix64, slices

BLOCK = 64
SHARD_SLOTS = 16_384
#: Up to so many shards have a task each; beyond, a task has at most SHARDS_PER_TASK.
FEW_SHARDS = 200
SHARDS_PER_TASK = 64
STREAM_DOCS = 4_000
MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 20


@dataclass
class SourceShare:
    """One source: its number, weight, size in words, blocks, target in words and in slots."""

    number: int
    source: str | None
    size: int
    blocks: int
    target: float
    slots: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], limit: float = MAX_REPEATS) -> list[float]:
    """Targets by weight that sum to the total size, none above ``limit`` times its own size.

    A source stops at its limit; what it leaves is reshared by weight among the
    others until none is above.  Sources reach their limit in the order of
    limit / weight, so one pass in that order settles all.
    """
    targets = [0.0] * len(sizes)
    left, weight = float(sum(sizes)), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: limit * sizes[i] / weights[i])
    for n, i in enumerate(order):
        if limit * sizes[i] * weight > left * weights[i]:
            for j in order[n:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = float(limit * sizes[i])
        left -= targets[i]
        weight -= weights[i]
    return targets


def lay_out(docs: DataFrame) -> tuple[DataFrame, list[SourceShare]]:
    """Documents with their place: source number, stream, first word in it, and the stream's first block."""
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("key", F.xxhash64("doc_id", "text")).drop("text")
    counts = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = stage_table(
        counts.select("source", "source_size", (F.row_number().over(order) - 1).alias("number"), F.ceil(F.col("n_docs") / STREAM_DOCS).alias("streams")),
        "mix-sources",
    )
    numbered = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "key", "number", "source_size", F.pmod(F.col("key"), F.col("streams")).alias("stream")
    )
    along = Window.partitionBy("number", "stream").orderBy("doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage_table(
        numbered.withColumn("first", F.coalesce(F.sum("size").over(along), F.lit(0))).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "mix-placed",
    )
    streams = placed.groupBy("number", "stream").agg(F.ceil(F.sum("size") / BLOCK).cast("long").alias("n_blocks"))
    before = Window.partitionBy("number").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    streams = stage_table(streams.withColumn("first_block", F.coalesce(F.sum("n_blocks").over(before), F.lit(0))), "mix-streams")
    totals = streams.groupBy("number").agg(F.sum("n_blocks").alias("blocks"))
    rows = sources.join(totals, "number").orderBy("number").collect()
    sizes = [r["source_size"] for r in rows]
    targets = water_fill(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    shares = [
        SourceShare(r["number"], r["source"], size, r["blocks"], target, round(target * r["blocks"] / size) if size else 0)
        for r, size, target in zip(rows, sizes, targets, strict=True)
    ]
    placed = placed.join(streams.drop("n_blocks"), ["number", "stream"])
    return placed, shares


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _tasks(shards: int) -> int:
    """Tasks that draw and place the shards; they grow with the corpus."""
    return max(1, min(shards, FEW_SHARDS), -(-shards // SHARDS_PER_TASK))


def draw_slots(docs: DataFrame, shares: list[SourceShare], seed: int = SEED) -> DataFrame:
    """(shard, number, block, repeat): one row per slot of the mix."""
    spark = docs.sparkSession
    wanted = np.array([s.slots for s in shares], np.int64)
    total = int(wanted.sum())
    shards = -(-total // SHARD_SLOTS)
    odds = wanted / max(total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                size = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
                count = rng.multinomial(size, odds)
                yield pd.DataFrame({"shard": shard, "number": np.arange(len(count)), "count": count})[count > 0]

    cells = stage_table(
        spark.range(shards, numPartitions=_tasks(shards)).mapInPandas(draw, "shard long, number long, count long"), "mix-cells"
    )
    along = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("count").over(along), F.lit(0)))
    limits = spark.createDataFrame([(s.number, s.slots) for s in shares], "number long, slots long")
    cells = cells.join(limits, "number")
    own = cells.select(
        "shard", "number", F.col("first").alias("low"), F.least(F.col("first") + F.col("count"), F.col("slots")).alias("high")
    )
    # Slots past a source's share, numbered, go to the places that are still open in other sources.
    spare = (
        cells.withColumn("over", F.least("count", F.col("first") + F.col("count") - F.col("slots")))
        .filter("over > 0")
        .withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("over"))))
        .select("shard", F.row_number().over(Window.orderBy("number", "shard", "unit")).alias("deal"))
    )
    filled = cells.groupBy("number", "slots").agg(F.sum("count").alias("drawn"))
    short = (
        limits.join(filled.select("number", "drawn"), "number", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .filter("drawn < slots")
        .withColumn("place", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)))
        .select("number", "place", F.row_number().over(Window.orderBy("number", "place")).alias("deal"))
    )
    dealt = spare.join(short, "deal").select("shard", "number", F.col("place").alias("low"), (F.col("place") + 1).alias("high"))
    blocks = {s.number: s.blocks for s in shares}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                n = blocks[row.number]
                place = np.arange(row.low, row.high)
                turn = place // n
                block = np.empty(len(place), np.int64)
                for t in np.unique(turn):
                    at = turn == t
                    block[at] = permute(place[at] % n, n, seed + 1009 * row.number + 31 * int(t))
                yield pd.DataFrame({"shard": row.shard, "number": row.number, "block": block, "repeat": turn})

    ranges = own.filter("high > low").unionByName(dealt).repartition(_tasks(shards), "shard", "number")
    return ranges.mapInPandas(place, "shard long, number long, block long, repeat long")


def block_ranges(placed: DataFrame) -> DataFrame:
    """One row per document and block it has words in: the words' range inside the document."""
    end = F.col("first") + F.col("size")
    low = F.floor(F.col("first") / BLOCK).cast("long")
    high = F.floor((end - 1) / BLOCK).cast("long")
    pieces = placed.filter("size > 0").withColumn("local", F.explode(F.sequence(low, high)))
    return (
        pieces.withColumn("begin", F.greatest(F.col("local") * BLOCK, F.col("first")) - F.col("first"))
        .withColumn("stop", F.least((F.col("local") + 1) * BLOCK, end) - F.col("first"))
        .withColumn("block", F.col("local") + F.col("first_block"))
    )


def mix_counts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes, repeats counted."""
    docs = require(docs, {"doc_id": "long", "text": "string", "source": "string"})
    placed, shares = lay_out(docs)
    # Catalyst takes the slots for as small as the draws that they come from; they grow with the corpus.
    used = draw_slots(docs, shares, seed).groupBy("number", "block").agg(F.count("*").alias("uses")).hint("merge")
    targets = docs.sparkSession.createDataFrame([(s.number, s.target) for s in shares], "number long, target double")
    pieces = block_ranges(placed).select("row", "number", "block", (F.col("stop") - F.col("begin")).alias("words"))
    taken = pieces.join(used, ["number", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return (
        placed.join(taken, "row", "left")
        .join(targets, "number")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each pass over a source, a document's words that the pass takes.

    The result has the columns of ``documents``; a document taken in several
    passes gives as many rows, a document not taken none.  Runs of taken words
    keep their text; a line break parts runs that do not touch.
    """
    bounded_batches(docs.sparkSession)
    docs = documents_like(docs)
    placed, shares = lay_out(docs.select("doc_id", "text", "source"))
    slots = draw_slots(docs, shares, seed).select("number", "block", "repeat").hint("merge")
    ranges = (
        block_ranges(placed)
        .join(slots, ["number", "block"])
        .groupBy("row", "doc_id", "key", "repeat")
        .agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("runs"))
        .groupBy("key", F.col("doc_id").alias("owner"))
        .agg(F.collect_list("runs").alias("passes"))
    )
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(ranges, "key").filter(F.col("doc_id").eqNullSafe(F.col("owner")))
    # Rows that repeat a document have their passes together; one of them carries all.
    single = joined.dropDuplicates(["key", "owner"]).select(*DOCUMENT_COLUMNS, "passes")
    return single.mapInArrow(cut_runs, "doc_id long, text string, lang string, source string, n_chars long")


@freeing
def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pass with the text of its word runs."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        for part in slices(batch, "text"):
            row, texts = [], []
            for i, (text, passes) in enumerate(zip(part.column("text").to_pylist(), part.column("passes").to_pylist(), strict=True)):
                spans = [m.span() for m in word.finditer(text)]
                for runs in passes:
                    joined: list[list[int]] = []
                    for run in runs:
                        if joined and joined[-1][1] == run["begin"]:
                            joined[-1][1] = run["stop"]
                        else:
                            joined.append([run["begin"], run["stop"]])
                    row.append(i)
                    texts.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined))
            kept = part.select(["doc_id", "lang", "source"]).take(pa.array(row, pa.int64()))
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), pa.array(texts, pa.string()), kept.column("lang"), kept.column("source"), chars],
                names=list(DOCUMENT_COLUMNS),
            )
