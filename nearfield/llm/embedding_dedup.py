"""Near-duplicate embeddings by NN-descent.

Vectors are linked when their labels are equal and their cosine, in double
precision, reaches the threshold.  Equal vectors are collapsed first.  A
neighbour graph is started from random-projection leaves and refined in rounds:
at every vector its neighbours and reverse neighbours are compared with each
other (neighbours of neighbours), and every vector keeps the best it has met.
A list that is full of links is saturated and may hold twice as many in the
next round.  The rounds end when few lists change.

Edges at or above the threshold of all rounds give first components.  What the
rounds did not meet, or bounded lists could not hold, is always found exactly: inside a label, blocks of near
vectors are compared with each other unless their centres and radii rule a link
out, and components joined by a link are merged.  So no link joins two
components.  Links are then counted exactly: all links of a vector lie in its
component, whose members are compared block against block, and only counts
leave the tasks, never pairs.

Every stage is keyed by vector, leaf piece or block pair: no task holds a whole
label or component.  Vectors that are spread out evenly rule out nothing, and
the block products then grow with the square of a label.

Defined results: a null vector or label, a zero vector, and a vector with a
null or non-finite component link with nothing; vectors of different lengths
do not link; repeated rows (same vec_id) are separate vectors that link with
each other when they are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import require, stage_table
from nearfield.llm.components import connected_components

THRESHOLD = 0.93
#: Neighbours of a list that is not saturated, and how many reverse neighbours a round looks at.
NEIGHBOURS = 8
REVERSE = 8
MAX_NEIGHBOURS = 64
#: Neighbours that a member of a leaf or of a local join learns of at once.
MEET = 3
TREES = 12
LEAF = 24
#: The descent compares in single precision; links this near the threshold are decided in double.
SLACK = 1e-5
MIN_ROUNDS, MAX_ROUNDS = 2, 6
#: Rounds go on while more than this share of the lists change.
CHANGE = 0.02
BLOCK = 512
#: Vectors of a block when components are compared with each other, and vectors that may be drawn for their cells.
MERGE_BLOCK = 4096
MAX_PIVOTS = 4096
SEED = 4


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector, unit): vectors as float64 bytes and as unit float32 bytes, null where nothing can link."""
    rows = require(embeddings, {"vec_id": "long", "embedding": "array<double>", "label": "int"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("embedding")
                out = []
                for i, label in enumerate(part.column("label").is_valid().to_pylist()):
                    values = lists[i].values if lists[i].is_valid else None
                    good = label and values is not None and len(values) > 0 and values.null_count == 0
                    if good:
                        v = np.asarray(values, np.float64) + 0.0  # no negative zeros
                        good = bool(np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0)
                    out.append(v if good else None)
                columns = [
                    part.column("vec_id"),
                    part.column("label"),
                    pa.array([None if v is None else v.tobytes() for v in out], pa.binary()),
                    pa.array([None if v is None else (v / np.linalg.norm(v)).astype(np.float32).tobytes() for v in out], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "unit"])

    cleaned = rows.mapInArrow(run, "vec_id long, label int, vector binary, unit binary")
    return stage_table(cleaned, "nn-rows")


def _matrix(column: pd.Series) -> np.ndarray:
    """Unit rows of vectors of one length."""
    m = np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_length(rows: pd.DataFrame, column: str = "vector") -> Iterator[pd.DataFrame]:
    for _, same in rows.groupby(rows[column].map(len), sort=True):
        yield same


def _group_pairs(groups: DataFrame, best: int = MEET) -> DataFrame:
    """(src, dst, sim): inside every row's ``members`` (lists of node and unit vector), each member's ``best`` nearest.

    Groups of one size are compared together, as one stack of small products.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                lists = batch.column("members").slice(at, 1000)
                flat = lists.flatten()
                nodes = flat.field("node").to_numpy(zero_copy_only=False)
                vectors = flat.field("unit").to_pylist()
                sizes = np.diff(lists.offsets.to_numpy())
                firsts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                lengths = np.array([len(v) for v in vectors], np.int64)
                for size in np.unique(sizes[sizes > 1]):
                    rows = firsts[sizes == size][:, None] + np.arange(size)
                    alike = (lengths[rows] == lengths[rows[:, :1]]).all(1)
                    for group in (rows[alike & (lengths[rows[:, 0]] == n)] for n in np.unique(lengths[rows[alike, 0]])):
                        stack = np.frombuffer(b"".join(vectors[i] for i in group.ravel()), np.float32).reshape(len(group), size, -1)
                        yield _nearest(nodes[group], stack @ stack.transpose(0, 2, 1), best)
                    for group in rows[~alike]:
                        for n in np.unique(lengths[group]):
                            own = group[lengths[group] == n]
                            if len(own) > 1:
                                unit = np.frombuffer(b"".join(vectors[i] for i in own), np.float32).reshape(1, len(own), -1)
                                yield _nearest(nodes[own][None], unit @ unit.transpose(0, 2, 1), best)

    return groups.select("members").mapInArrow(run, "src long, dst long, sim double")


def _nearest(nodes: np.ndarray, sims: np.ndarray, best: int) -> pa.RecordBatch:
    size = nodes.shape[1]
    sims[:, np.arange(size), np.arange(size)] = -2.0
    best = min(best, size - 1)
    near = np.argpartition(-sims, best - 1, axis=2)[:, :, :best]
    src = np.repeat(nodes[:, :, None], best, axis=2)
    dst = np.take_along_axis(np.repeat(nodes[:, None, :], size, axis=1), near, axis=2)
    sim = np.take_along_axis(sims, near, axis=2).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (src, dst, sim)], names=["src", "dst", "sim"])


def _members(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("node", "unit")).alias("members"))


def leaf_pairs(nodes: DataFrame, seed: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Starting edges: best neighbours inside random-projection leaves of every label.

    A leaf is the signs of a vector's projections on seeded random directions;
    the number of directions follows the label's size.  A leaf with more than
    ``leaf`` vectors, a hot one included, is dealt into pieces by a hash.
    """
    sizes = nodes.groupBy("label").agg(F.count("*").alias("of_label"))
    sized = nodes.join(sizes, "label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for same in _by_length(frame, "unit"):
                unit = np.frombuffer(b"".join(same["unit"]), np.float32).reshape(len(same), -1)
                depth = np.ceil(np.log2(np.maximum(same["of_label"].to_numpy() / leaf, 1))).astype(np.int64)
                for tree in range(trees):
                    rng = np.random.default_rng([seed, tree, unit.shape[1]])
                    bits = (unit @ rng.normal(size=(unit.shape[1], 40)) > 0).astype(np.int64)
                    code = (bits @ (1 << np.arange(40))) & ((1 << np.minimum(depth, 40)) - 1)
                    yield pd.DataFrame({"tree": tree, "label": same["label"], "leaf": code, "node": same["node"]})

    placed = sized.select("node", "label", "unit", "of_label").mapInPandas(run, "tree int, label int, leaf long, node long")
    keys = ["label", "tree", "leaf"]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    piece = F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.ceil(F.col("n") / leaf).cast("long"))
    dealt = placed.join(counts, keys).withColumn("piece", piece)
    full = dealt.select(*keys, "piece", "node").join(nodes.select("node", "unit"), "node")
    return _group_pairs(_members(full, [*keys, "piece"]))


def _best(edges: DataFrame, room: DataFrame) -> DataFrame:
    """The lists: per src its best ``room`` edges (NEIGHBOURS where room has no row)."""
    unique = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    ranked = unique.withColumn("rank", F.row_number().over(order))
    return (
        ranked.filter(F.col("rank") <= MAX_NEIGHBOURS)
        .join(room, "src", "left")
        .filter(F.col("rank") <= F.coalesce("room", F.lit(NEIGHBOURS)))
        .select("src", "dst", "sim", "rank")
    )


def _saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """(src, room): lists that hold only links get twice the room."""
    full = lists.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    return full.filter((F.col("n") >= NEIGHBOURS) & (F.col("least") >= threshold)).select(
        "src", F.least(F.col("n") * 2, F.lit(MAX_NEIGHBOURS)).alias("room")
    )


def _local_joins(nodes: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """Edges met by comparing, at every vector, a bounded choice of its neighbours and reverse neighbours."""
    forward = lists.filter(F.col("rank") <= NEIGHBOURS).select(F.col("src").alias("at"), F.col("dst").alias("node"))
    # Of a long list, links past the first ones take turns by hash, so that they are all passed on in time.
    later = lists.filter(F.col("rank") > NEIGHBOURS).filter(F.pmod(F.xxhash64("src", "dst", F.lit(turn)), F.lit(8)) == 0)
    later = later.select(F.col("src").alias("at"), F.col("dst").alias("node"))
    back = lists.select(F.col("dst").alias("at"), F.col("src").alias("node"), "sim")
    counts = back.groupBy("at").agg(F.count("*").alias("n"))
    # A popular vector looks at about REVERSE of its reverse neighbours, drawn by hash before anything is gathered.
    drawn = back.join(counts, "at").filter(F.pmod(F.xxhash64("at", "node", F.lit(turn)), F.col("n")) < REVERSE)
    around = forward.unionByName(later).unionByName(drawn.select("at", "node")).distinct()
    return _group_pairs(_members(around.join(nodes.select("node", "unit"), "node"), ["at"]))


def nn_descent(nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """The links (src, dst, sim) that the neighbour lists of any round held."""
    none = nodes.select(F.col("node").alias("src"), F.lit(0).cast("long").alias("room")).limit(0)
    lists = stage_table(_best(leaf_pairs(nodes, seed), none), "nn-lists")
    total, met_links = max(nodes.count(), 1), [lists]
    for turn in range(MAX_ROUNDS):
        room = _saturated(lists, threshold - SLACK)
        met = _local_joins(nodes, lists, turn).unionByName(lists.select("src", "dst", "sim"))
        new = stage_table(_best(met, room), "nn-lists")
        changed = new.join(lists, ["src", "dst"], "left_anti").select("src").distinct().count()
        lists = new
        met_links.append(new)
        if turn + 1 >= MIN_ROUNDS and changed <= CHANGE * total:
            break
    links = [x.filter(F.col("sim") >= threshold - SLACK).select("src", "dst", "sim") for x in met_links]
    return reduce(DataFrame.unionByName, links)


def true_links(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges (src, dst, sim) at or above the threshold; close cases are decided in double precision."""
    edges = lists.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "sim")
    sure = edges.filter(F.col("sim") >= threshold + SLACK).select("a", "b")
    close = edges.filter((F.col("sim") < threshold + SLACK) & (F.col("sim") >= threshold - SLACK)).select("a", "b").distinct()
    sides = [nodes.select(F.col("node").alias(x), F.col("vector").alias(f"v{x}")) for x in "ab"]

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cosine = (_matrix(frame["va"]) * _matrix(frame["vb"])).sum(1) if len(frame) else np.zeros(0)
            yield frame.loc[cosine >= threshold, ["a", "b"]]

    return sure.unionByName(close.join(sides[0], "a").join(sides[1], "b").mapInPandas(decide, "a long, b long"))


def _cells(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``cell``: the nearest of some vectors drawn from a label that fills several blocks, else 0.

    Cells only make blocks tight; which vectors are drawn changes no result.
    """
    sizes = nodes.groupBy("label").agg(F.count("*").alias("of_label")).filter(F.col("of_label") > MERGE_BLOCK)
    draw = F.least(F.ceil(2 * F.col("of_label") / MERGE_BLOCK), F.lit(64))
    drawn = nodes.join(F.broadcast(sizes), "label").filter(F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("of_label")) < draw)
    pivots = drawn.orderBy(F.xxhash64("node"), "node").limit(MAX_PIVOTS).select("label", "vector").toPandas()
    known = {key: _matrix(p["vector"]) for key, p in pivots.groupby([pivots["label"], pivots["vector"].map(len)])} if len(pivots) else {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for same in _by_length(frame):
                unit, length, cell = _matrix(same["vector"]), len(same["vector"].iloc[0]), np.zeros(len(same), np.int32)
                for label in same["label"].unique():
                    if (label, length) in known:
                        own = (same["label"] == label).to_numpy()
                        cell[own] = np.argmax(unit[own] @ known[label, length].T, axis=1)
                yield same.assign(length=length, cell=cell)

    kinds = "label int, vector binary, node long, component long, length int, cell int"
    return nodes.select("label", "vector", "node", "component").mapInPandas(run, kinds)


def cross_links(nodes: DataFrame, components: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(a, b): components joined by a link, with every pair of vectors of a label looked at or ruled out.

    The vectors of a label stand in blocks of near ones.  Two blocks meet unless
    their centres are further apart than their radii and the threshold's angle
    allow (angles obey the triangle inequality).  A task compares one pair of
    blocks and returns a forest over the components that it joins, never pairs.
    """
    block = block or MERGE_BLOCK
    named = nodes.join(components.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = _cells(named)
    keys = ["label", "length", "cell"]
    large = placed.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("pieces")).filter("pieces > 1")
    piece = F.pmod(F.xxhash64("node", F.lit(SEED)), F.coalesce("pieces", F.lit(1))).cast("int")
    dealt = stage_table(placed.join(F.broadcast(large), keys, "left").withColumn("piece", piece).drop("pieces"), "nn-blocks")
    keys = [*keys, "piece"]

    def head(rows: pd.DataFrame) -> pd.DataFrame:
        unit = _matrix(rows["vector"])
        centre = unit.mean(0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if centre.any() else np.pi
        first = rows.iloc[0]
        lone = first["component"] if (rows["component"] == first["component"]).all() else -1
        return pd.DataFrame([(*first[keys], centre.tobytes(), radius, lone)], columns=[*keys, "centre", "radius", "lone"])

    heads = dealt.groupBy(*keys).applyInPandas(head, "label int, length int, cell int, piece int, centre binary, radius double, lone long")
    heads = stage_table(heads, "nn-heads")
    sides = [heads.select("label", "length", *[F.col(c).alias(f"{c}_{x}") for c in ("cell", "piece", "centre", "radius", "lone")]) for x in "ab"]
    # Pairs in which all vectors are of one component cannot join two.
    pairs = sides[0].join(sides[1], ["label", "length"]).filter(
        "struct(cell_a, piece_a) <= struct(cell_b, piece_b) and not (lone_a >= 0 and lone_a = lone_b)"
    )
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for same in _by_length(frame, "centre_a"):
                a, b = (np.frombuffer(b"".join(same[c]), np.float64).reshape(len(same), -1) for c in ("centre_a", "centre_b"))
                apart = np.arccos(np.clip((a * b).sum(1), -1, 1))
                # A block of opposite vectors has no centre, and its radius is then the widest angle.
                reach = same["radius_a"] + same["radius_b"] + widest
                yield same.loc[(apart <= reach) | ~a.any(1) | ~b.any(1), ["label", "length", "cell_a", "piece_a", "cell_b", "piece_b"]]

    pairs = pairs.mapInPandas(near, "label int, length int, cell_a int, piece_a int, cell_b int, piece_b int")
    pairs = stage_table(pairs.withColumn("pair", F.monotonically_increasing_id()), "nn-pairs")
    same_block = (F.col("cell_a") == F.col("cell_b")) & (F.col("piece_a") == F.col("piece_b"))
    ends = [
        pairs.filter(keep).select("label", "length", F.col(f"cell_{x}").alias("cell"), F.col(f"piece_{x}").alias("piece"), "pair", F.lit(x == "a").alias("first"))
        for x, keep in (("a", F.lit(True)), ("b", ~same_block))
    ]
    sent = dealt.join(ends[0].unionByName(ends[1]), keys).select("pair", "first", "component", "vector")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows[rows["first"]]
        b = a if rows["first"].all() else rows[~rows["first"]]
        names, code = np.unique(np.concatenate((a["component"], b["component"])), return_inverse=True)
        of_a, of_b, right = code[: len(a)], code[len(a) :], _matrix(b["vector"]).T
        left, up, forest = _matrix(a["vector"]), list(range(len(names))), []
        for at in range(0, len(a), BLOCK):
            i, j = np.nonzero(left[at : at + BLOCK] @ right >= threshold)
            i, j = of_a[at + i], of_b[j]
            joined = np.unique(i[i != j] * len(names) + j[i != j])
            for x, y in zip((joined // len(names)).tolist(), (joined % len(names)).tolist(), strict=True):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    forest.append((names[x], names[y]))
        return pd.DataFrame(forest, columns=["a", "b"])

    return sent.groupBy("pair").applyInPandas(compare, "a long, b long")


def merge_components(nodes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of the components that no link joins any more."""
    joined = connected_components(cross_links(nodes, components, threshold)).select(F.col("id").alias("old"), F.col("component").alias("new"))
    everyone = nodes.select(F.col("node").alias("id")).join(components, "id", "left").withColumn("old", F.coalesce("component", "id"))
    merged = everyone.join(joined, "old", "left").select("id", F.coalesce("new", "old").alias("component"))
    return stage_table(merged, "nn-merged")


def count_links(nodes: DataFrame, components: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, linked): how many other rows each node links, copies counted; block against block inside components.

    ``nodes`` carries ``copies``, the number of rows with that very vector.
    """
    members = nodes.join(components.withColumnRenamed("id", "node"), "node")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets every block of its component; pair (i, j) stands at the smaller one's side.
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") <= F.col("other")).alias("first"),
        "node",
        "vector",
        "copies",
    )

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        same_block = rows["low"].iloc[0] == rows["high"].iloc[0]
        for same in _by_length(rows):
            a = same if same_block else same[same["first"]]
            b = same if same_block else same[~same["first"]]
            if not len(a) or not len(b):
                continue
            near = _matrix(a["vector"]) @ _matrix(b["vector"]).T >= threshold
            if same_block:
                np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"node": a["node"], "linked": near @ b["copies"].to_numpy()}))
            if not same_block:
                out.append(pd.DataFrame({"node": b["node"], "linked": near.T @ a["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "linked": []})

    return sent.groupBy("component", "low", "high").applyInPandas(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def embedding_links(embeddings: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding, label)."""
    rows = clean_vectors(embeddings)
    nodes = stage_table(
        rows.filter("vector is not null")
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("unit").alias("unit"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nn-nodes",
    )
    links = true_links(nodes, nn_descent(nodes, threshold, seed), threshold)
    components = stage_table(connected_components(links), "nn-components")
    components = merge_components(nodes, components, threshold)
    linked = count_links(nodes, components, threshold)
    named = nodes.select("node", "label", "vector", "copies", "low").join(components.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).join(linked, "node", "left")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = named.join(lowest, "component").select(
        "label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return (
        rows.join(facts, ["label", "vector"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
