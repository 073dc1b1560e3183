"""MinHash near-duplicates of documents: ProbMinHash, banding, verification.

A document is the bag of its runs of five words (lower-cased words parted by
white space); a run that the document has n times weighs 1 + log2(n).  ProbMinHash
estimates the probability Jaccard similarity of two such bags: every distinct
run sends arrivals of a Poisson process of rate equal to its weight to random
registers, a register keeps the run that arrives first, and a run stops as
soon as its next arrival comes later than the last arrival of any register.
Documents whose registers agree on a whole band are candidates; a candidate
pair is verified exactly, on the full bags: it links when the probability
Jaccard of the weighted runs, or the Jaccard of the plain sets of runs, reaches
the threshold (the two differ only where runs repeat inside a text).

Equal texts are collapsed before banding.  A band value shared by many
documents is not expanded into pairs: the smallest document of the group is
compared with all others and links are followed to components.  Groups that
still hold several components go on: a few pivots are compared with the members
of other components; what is left outside a group's main component after that is
compared with all of its group, pair by pair in small groups and block against
block inside tasks in large ones, where only links leave the tasks.  No candidate
is dropped, and no pair inside a known component is emitted.

Defined results: a null text or one without words is a class of its own; a
row with a null doc_id belongs to the class of its exact copies, else its class
is null; a text of fewer than five words is one run; repeated rows share a
class; equal ids with different texts are told apart by text; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, documents_like, freeing, require, stage_table
from nearfield.llm.components import connected_components
from nearfield.llm.texthash import mix64, segment_hash, slices, split_words, window_hash

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 5
#: Members of every group that are compared with its other components in the second round.
PIVOTS = 8
#: Groups up to this size are finished pair by pair, larger ones block against block.
SMALL_GROUP = 24
BLOCK_TEXTS = 256
#: Runs (columns) of one product of incidence matrices.
BLOCK_RUNS = 16_384
#: Bits of a run's hash that are kept; documents of one slice are told apart by the bits above.
_HASH_BITS = 48
_MASK = np.uint64((1 << _HASH_BITS) - 1)


def weighted_shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of the distinct runs of each text, sorted, and a hash of each whole text's words (0: none)."""
    words = split_words(pc.utf8_lower(texts.fill_null("")))
    doc, _, code = window_hash(words, width)
    key = np.sort((code & _MASK) | doc.astype(np.uint64) << np.uint64(_HASH_BITS))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = 1.0 + np.log2(np.diff(np.append(first, len(key))))
    whole = np.zeros((words.n_docs, 2), np.uint64)
    if len(words.starts):
        begin = np.flatnonzero(np.concatenate(([True], words.doc[1:] != words.doc[:-1])))
        end = np.append(begin[1:], len(words.starts))
        whole[words.doc[begin], 0] = segment_hash(words.hash, begin, end)
        whole[words.doc[begin], 1] = segment_hash(mix64(words.hash + np.uint64(1)), begin, end)
    return (key[first] >> np.uint64(_HASH_BITS)).astype(np.int64), key[first] & _MASK, weight, whole


def prob_min_hash(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Registers (n_docs, registers): the run that arrives first at each.

    All runs advance together, one arrival a round; those whose arrival is
    past the latest first arrival of their document's registers are done.
    Rows of documents without runs stay 0.
    """
    time = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, np.uint64)
    state = mix64(code + np.uint64(0x632BE59BD9B4E019))
    at = np.zeros(len(code))
    rate = weight.astype(np.float64)
    turn = 0
    while len(code):
        turn += 1
        draw = mix64(state + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # 53 bits give the waiting time, another mix gives the register.
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        place = doc * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(at < time[place])
        early = early[np.argsort(-at[early], kind="stable")]  # of several, the earliest is written last
        time[place[early]] = at[early]
        held[place[early]] = code[early]
        limit = time.reshape(n_docs, registers).max(1)
        alive = at < limit[doc]
        doc, code, rate, state, at = doc[alive], code[alive], rate[alive], state[alive], at[alive]
    return held.reshape(n_docs, registers)


def band_hashes(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per document and band, different for every band."""
    out = np.zeros((len(registers), bands), np.uint64)
    for band in range(bands):
        acc = np.full(len(registers), band + 1, np.uint64)
        for row in range(rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + registers[:, band * rows + row])
        out[:, band] = acc
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, t1, t2, bands) per row of ``docs`` (doc_id, text).

    ``key`` is a hash of the exact text, t1 and t2 of its words (null without
    words), ``bands`` the band hashes.
    """
    schema = "doc_id long, key long, t1 long, t2 long, bands array<long>"

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, code, weight, whole = weighted_shingles(part.column("text"))
                n = part.num_rows
                values = band_hashes(prob_min_hash(doc, code, weight, n, bands * rows), bands, rows).view(np.int64)
                none = whole[:, 0] == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(values.ravel()))
                t1, t2 = (pa.array(whole[:, i].view(np.int64), mask=none) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), t1, t2, lists], names=["doc_id", "key", "t1", "t2", "bands"]
                )

    return require(docs, {"doc_id": "long", "text": "string"}).withColumn("key", F.xxhash64("text")).mapInArrow(run, schema)


def probability_jaccard(code_a: np.ndarray, weight_a: np.ndarray, code_b: np.ndarray, weight_b: np.ndarray) -> float:
    """Exact probability Jaccard of two bags with sorted distinct codes.

    The sum over common runs i of 1 / sum_j max(a_j / a_i, b_j / b_i).  With
    runs ordered by a_i / b_i the inner maxima split into a prefix that b
    decides and a suffix that a decides, so sorting gives all sums.
    """
    common, ia, ib = np.intersect1d(code_a, code_b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = weight_a[ia].astype(np.float64), weight_b[ib].astype(np.float64)
    total_a, total_b = float(weight_a.sum()), float(weight_b.sum())
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # For run i, j of ratio a_j / b_j above i's count a_j / a_i, the others b_j / b_i.
    above_a = np.append(np.cumsum(a[::-1])[::-1][1:], 0.0) + (total_a - a.sum())
    upto_b = np.cumsum(b) + (total_b - b.sum())
    return float(np.sum(1.0 / (above_a / a + upto_b / b)))


def plain_jaccard(code_a: np.ndarray, code_b: np.ndarray) -> float:
    both = len(np.intersect1d(code_a, code_b, assume_unique=True))
    return both / max(len(code_a) + len(code_b) - both, 1)


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, text_a, text_b) whose bags reach the threshold."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keep = []
                sides = []
                for name in ("text_a", "text_b"):
                    doc, code, weight, _ = weighted_shingles(part.column(name))
                    cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    sides.append([(code[i:j], weight[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
                for a, b in zip(*sides, strict=True):
                    keep.append(plain_jaccard(a[0], b[0]) >= threshold or probability_jaccard(*a, *b) >= threshold)
                out = part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                if out.num_rows:
                    yield out
    return pairs.mapInArrow(run, "a long, b long")


def _compare(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    side_a = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    side_b = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return stage_table(_similar(pairs.join(side_b, "b").join(side_a, "a"), threshold), "minhash-links")


def _links_between(texts_a: pa.Array, texts_b: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the similar pairs of two blocks of texts.

    Products of incidence matrices over the runs that both blocks hold give
    every pair's common runs, and the shares p and q of either text's weight that
    the common runs carry; the probability Jaccard never exceeds 1 / (1/p + 1/q - 1),
    and is that where runs weigh alike.  Only pairs whose bound reaches the threshold
    are computed exactly.
    """
    sides = [weighted_shingles(t)[:3] for t in (texts_a, texts_b)]
    vocabulary = np.intersect1d(sides[0][1], sides[1][1])
    n = [len(texts_a), len(texts_b)]
    sizes = [np.bincount(doc, minlength=k) for (doc, _, _), k in zip(sides, n, strict=True)]
    mass = [np.bincount(doc, weight, minlength=k) for (doc, _, weight), k in zip(sides, n, strict=True)]
    common, from_a, from_b = (np.zeros(n, np.float32) for _ in range(3))
    column = [np.searchsorted(vocabulary, code) for _, code, _ in sides]
    shared = [c < len(vocabulary) for c in column]
    for c, s, (_, code, _) in zip(column, shared, sides, strict=True):
        s[s] = vocabulary[c[s]] == code[s]
    for at in range(0, len(vocabulary), BLOCK_RUNS):
        width = min(BLOCK_RUNS, len(vocabulary) - at)
        present, heavy = [], []
        for c, s, (doc, _, weight), k in zip(column, shared, sides, n, strict=True):
            own = s & (c >= at) & (c < at + width)
            has, heft = np.zeros((k, width), np.float32), np.zeros((k, width), np.float32)
            has[doc[own], c[own] - at] = 1
            heft[doc[own], c[own] - at] = weight[own]
            present.append(has)
            heavy.append(heft)
        common += present[0] @ present[1].T
        from_a += heavy[0] @ present[1].T
        from_b += present[0] @ heavy[1].T
    union = np.maximum(sizes[0][:, None] + sizes[1][None, :] - common, 1)
    linked = common / union >= threshold - 1e-6
    # A term 1 / sum_j max(a_j / a_i, b_j / b_i) is at most 1 / (A / a_i + B_only / b_i), which is concave
    # and homogeneous in (a_i, b_i): the sum over i is at most its value at the sums of a_i and b_i.
    with np.errstate(divide="ignore", invalid="ignore"):  # texts without runs, or without common ones
        bound = 1 / (mass[0][:, None] / from_a + mass[1][None, :] / from_b - 1)
    cuts = [np.searchsorted(doc, np.arange(k + 1)) for (doc, _, _), k in zip(sides, n, strict=True)]
    for i, j in zip(*np.nonzero(~linked & (bound >= threshold - 1e-4)), strict=True):
        (x, y), (u, v) = cuts[0][i : i + 2], cuts[1][j : j + 2]
        linked[i, j] = probability_jaccard(sides[0][1][x:y], sides[0][2][x:y], sides[1][1][u:v], sides[1][2][u:v]) >= threshold
    return np.nonzero(linked)


def _compare_blocks(placed: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of the members outside a group's main component with all members of the group.

    Both sides of a group are dealt into blocks by a hash, and each block of
    outside members meets every other block in a task of its own; only links
    leave the tasks.
    """
    inside = F.col("component") == F.col("main")
    sizes = placed.groupBy("value").agg(
        F.ceil(F.count_if(inside) / BLOCK_TEXTS).cast("int").alias("n_in"),
        F.ceil(F.count_if(~inside) / BLOCK_TEXTS).cast("int").alias("n_out"),
    )
    # Blocks are numbered through a group: those of outside members first, the others after them.
    number = F.pmod(F.xxhash64("node", F.lit(1)), F.when(inside, F.col("n_in")).otherwise(F.col("n_out"))).cast("int")
    dealt = placed.join(sizes, "value").withColumn("block", F.when(inside, F.col("n_out") + number).otherwise(number))
    # An outside block meets all blocks, an inside one the outside ones.
    others = F.when(inside, F.sequence(F.lit(0), F.col("n_out") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("n_out") + F.col("n_in") - 1)
    )
    sent = dealt.select("value", "node", "block", F.explode(others).alias("other")).select(
        "value", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    full = sent.join(bodies, "node")

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["block"] == rows["i"]], rows[rows["block"] == rows["j"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        i, j = _links_between(pa.array(a["text"], pa.string()), pa.array(b["text"], pa.string()), threshold)
        pairs = pd.DataFrame({"a": a["node"].to_numpy()[i], "b": b["node"].to_numpy()[j]})
        return pairs[pairs["a"] < pairs["b"]] if a is b or rows["i"].iloc[0] == rows["j"].iloc[0] else pairs

    return stage_table(full.groupBy("value", "i", "j").applyInPandas(links, "a long, b long"), "minhash-links")


def _link_texts(groups: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of all nodes in ``groups`` (value, node, size, low)."""
    def label(links: DataFrame) -> DataFrame:
        nodes = groups.select("node").distinct()
        components = connected_components(links).withColumnRenamed("id", "node")
        return stage_table(
            nodes.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "minhash-labels"
        )

    def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
        """The labels after further links, which are followed between components instead of nodes."""
        if links.isEmpty():
            return labels
        to_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        to_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        merged = connected_components(links.join(to_a, "a").join(to_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        merged = merged.select(F.col("id").alias("component"), F.col("component").alias("whole"))
        return stage_table(
            labels.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "minhash-labels"
        )

    def still_open(labels: DataFrame) -> DataFrame:
        """Members of the groups that hold several components, with the group's largest component as ``main``."""
        placed = groups.filter("size > 2").join(labels, "node")
        parts = placed.groupBy("value", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("value").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"))
        return stage_table(placed.join(mixed.filter("parts > 1").select("value", "main"), "value"), "minhash-open")

    def across(members: DataFrame, pivots: DataFrame) -> DataFrame:
        """Pairs (a, b) of a pivot and a member of its group in another component."""
        pivots = pivots.select("value", F.col("node").alias("p"), F.col("component").alias("pc"))
        pairs = members.join(pivots, "value").filter("component != pc")
        return pairs.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()

    first = groups.filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    labels = label(_compare(first, bodies, threshold))
    placed = still_open(labels)
    if placed.isEmpty():
        return labels
    # A node's turn is drawn by a hash of the node alone, so groups of much the same members take
    # much the same pivots.
    turn = F.pmod(F.xxhash64("node"), F.col("size"))
    links = _compare(across(placed, placed.filter(turn < PIVOTS)), bodies, threshold)
    if not links.isEmpty():
        labels = merge(labels, links)
        placed = still_open(labels)
        if placed.isEmpty():
            return labels
    # All that is left: members outside the main component against all of their group.
    small, large = placed.filter(F.col("size") <= SMALL_GROUP), placed.filter(F.col("size") > SMALL_GROUP)
    links = _compare(across(small, small.filter("component != main")), bodies, threshold)
    return merge(labels, links.unionByName(_compare_blocks(large, bodies, threshold)))


def near_duplicate_rows(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, class_id, text_id, component) per row of ``docs``.

    ``key`` is xxhash64(text); ``component`` tells classes apart even where
    ids repeat, and is null for rows that are compared with nothing.
    """
    docs = require(docs, {"doc_id": "long", "text": "string"})
    signed = stage_table(signatures(docs, bands, rows), "minhash-signatures")
    heads = stage_table(
        signed.filter("t1 is not null and doc_id is not null")
        .groupBy("t1", "t2")
        .agg(F.min(F.struct("doc_id", "key")).alias("row"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "minhash-heads",
    )
    members = heads.select("node", F.explode("bands").alias("value"))
    shared = members.groupBy("value").agg(F.count("*").alias("size"), F.min("node").alias("low")).filter("size > 1")
    groups = stage_table(members.join(shared, "value"), "minhash-groups")
    # Texts of candidates only, written once; every comparison reads from here.
    wanted = heads.join(groups.select("node").distinct(), "node").select("node", "row.doc_id", "row.key")
    bodies = stage_table(
        docs.filter("text is not null")
        .withColumn("key", F.xxhash64("text"))
        .join(wanted, ["doc_id", "key"])
        .select("node", "text")
        .dropDuplicates(["node"]),
        "minhash-texts",
    )
    labels = _link_texts(groups, bodies, threshold)
    named = heads.select("t1", "t2", "node", F.col("row.doc_id").alias("text_id")).join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("text_id").alias("class_id"))
    classes = named.join(lowest, "component").select("t1", "t2", "text_id", "class_id", "component")
    return (
        signed.select("doc_id", "key", "t1", "t2")
        .join(classes, ["t1", "t2"], "left")
        .select(
            "doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("text_id", "doc_id").alias("text_id"), "component"
        )
    )


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, text_id) per row: the smallest id of its class, and of the rows with its very words."""
    return near_duplicate_rows(docs, threshold).select("doc_id", "class_id", "text_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (columns of ``documents``) that stay: one of each class.

    The row with the class's smallest id stays, once if it repeats; rows
    without words or without an id all stay.
    """
    bounded_batches(docs.sparkSession)
    docs = documents_like(docs)
    found = stage_table(near_duplicate_rows(docs, threshold).filter("doc_id is not null and component is not null").drop("text_id"), "minhash-rows")
    chosen = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("row"))
    chosen = chosen.select("row.doc_id", "row.key").withColumn("stays", F.lit(True))
    rows = found.groupBy("doc_id", "key").agg(F.count("*").alias("copies")).join(chosen, ["doc_id", "key"], "left")
    rows = stage_table(rows.filter("stays is null or copies > 1"), "minhash-decided")
    keyed = docs.withColumn("key", F.xxhash64("text"))
    stay = keyed.join(rows.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    again = rows.filter("stays")
    if not again.isEmpty():
        stay = stay.unionByName(
            keyed.join(again.select("doc_id", "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
        )
    return stay.drop("key").select(*docs.columns)
