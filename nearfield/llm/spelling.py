"""Groups of spelling variants: words one edit apart, found in sorted vocabulary lists.

Words are runs of Latin letters of whole texts, with a planted slip: an
occurrence whose checksum is a multiple of 97 loses one letter.  They are
counted in the tasks, then over the corpus; only distinct words go on.

Two words are near if one inserted, deleted or replaced letter turns one into the
other.  The edit lies in the front half of the shorter word or in its back half,
so near words share the back half or the front half; the vocabulary is dealt by
(length of the shorter word, half, shared letters).  A list with more than
``GROUP`` words has its half of the word halved again, down to one letter,
where a list cannot hold more words than there are letters (squared, for the
longer ones); so a stem that a third of all words share is no hot group.

Within a list the words are sorted and neighbours' common prefixes make them a
tree of ranges.  All words of a block walk it level by level: the edit-matrix row
of a range is computed once for all its words from that of the range around it,
within the band of at most one edit, and ranges whose shared prefix already
exceeds one edit are left out with all their words.  A pair counts where its
first edit lies in the part of the word that the list stands for, so each pair
is found once.

A word's form is its near word of largest count, ties to the smaller word, if that
is at least twice as frequent; roots follow the forms by pointer doubling.

Defined results: a null text has no words; a row without ``doc_id`` takes part
with an empty id in its checksum; a repeated row counts again; ties go to the
smaller word in code-point order; words of any length are compared whole.  Only
``doc_id`` and ``text`` are read, so other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import checkpoint, require, stage_table
from nearfield.llm.suffix_dedup import text_bytes
from nearfield.llm.texthash import mix64, segment_hash, slices

MIN_LENGTH = 5
MIN_COUNT = 3
SLIP = 97
GROUP = 4_096
QUERY_BLOCK = 4_096
LIST_BYTES = 4 << 20
HELD_WORDS = 400_000

_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LONG_RUN = 48  # longer runs are checksummed one by one


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """crc32 of (a text with checksum ``prefix``) + data[start:end], for every run."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state = ~prefix[order].astype(np.uint32)
    at, size = starts[order], size[order]
    n_long = int(np.searchsorted(-size, -_LONG_RUN, side="left"))  # runs longer than _LONG_RUN come first
    for j in range(int(size[n_long]) if n_long < len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))
        now = state[n_long:n]
        state[n_long:n] = _CRC[(now ^ data[at[n_long:n] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(prefix[i]))
    return out


def words_of(texts: pa.Array, ids: list[int | None]) -> tuple[list[str], np.ndarray]:
    """Distinct words of a slice, after the slips, with their counts; shorter ones than MIN_LENGTH are left out."""
    data, bounds = text_bytes(texts)
    upper = (data >= 65) & (data <= 90)
    lower = np.where(upper, data + 32, data).astype(np.uint8)
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
    inside = upper | ((data >= 97) & (data <= 122)) | lead
    inside[1:] |= lead[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return [], np.zeros(0, np.int64)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    length = ends - starts - (leads[ends] - leads[starts])
    keep = length >= MIN_LENGTH  # a slip only shortens
    starts, ends, doc, length = starts[keep], ends[keep], doc[keep], length[keep]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = run_checksums(lower, starts, ends, prefix[doc])
    slip = crc % SLIP == 0
    raw = lower.tobytes()
    words: list[str] = []
    for a, b, h, n in zip(starts[slip].tolist(), ends[slip].tolist(), crc[slip].tolist(), length[slip].tolist(), strict=True):
        if n > MIN_LENGTH:
            run = raw[a:b].decode()
            words.append(run[: h % n] + run[h % n + 1 :])
    counts = [np.ones(len(words), np.int64)]
    starts, ends = starts[~slip], ends[~slip]
    _, first, n = np.unique(segment_hash(_CODES[lower], starts, ends), return_index=True, return_counts=True)
    words += [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, np.concatenate([*counts, n])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least MIN_LENGTH letters met at least MIN_COUNT times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n_held = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                words, counts = words_of(part.column("text"), part.column("doc_id").to_pylist())
                if not words:
                    continue
                held.append(pa.table({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())}))
                n_held += len(words)
                if n_held > 2 * HELD_WORDS:
                    one = merged()
                    held, n_held = [one], len(one)
                    if n_held > HELD_WORDS:
                        yield from one.to_batches(max_chunksize=50_000)
                        held, n_held = [], 0
        if held:
            yield from merged().to_batches(max_chunksize=50_000)

    docs = require(docs, {"doc_id": "long", "text": "string"})
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(f"n >= {MIN_COUNT}")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of a row's list: the letters in front of the part [a, b) of the shorter word and behind it."""
    head = F.expr("substring(word, 1, a)")
    tail = F.expr("right(word, short - b)")
    return rows.withColumn("key", F.xxhash64("short", "a", "b", head, tail))


def _parts(words: DataFrame) -> DataFrame:
    """Each word as the shorter one of a pair and as the longer one, for both halves of the shorter word."""
    letters = F.char_length("word")
    roles = words.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("short")).filter(f"short >= {MIN_LENGTH}")
    half = F.floor(F.col("short") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("short").alias("b")))
    return _keyed(roles.select("word", "n", "short", F.explode(parts).alias("part")).select("word", "n", "short", "part.a", "part.b"))


def _halved(rows: DataFrame) -> DataFrame:
    half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct("a", half.alias("b")), F.struct(half.alias("a"), "b"))
    return _keyed(rows.select("word", "n", "short", F.explode(parts).alias("part")).select("word", "n", "short", "part.a", "part.b"))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best): per word with near words their number and (minus count, word) of the most frequent one."""
    rows = _parts(words)
    found = None
    while True:
        rows = stage_table(rows, "spelling-parts")
        counts = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("b") - F.col("a")).alias("width"))
        hot = stage_table(counts.filter(f"size > {group} AND width > 1").select("key"), "spelling-hot")
        more = not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if more else rows
        near = stage_table(_walk_lists(cold), "spelling-near")
        found = near if found is None else found.unionByName(near)
        if not more:
            break
        rows = _halved(rows.join(hot, "key", "left_semi"))
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best")
    )


def _walk_lists(rows: DataFrame) -> DataFrame:
    """Near words within each list, per word, list by list."""
    schema = "word string, n_near long, best_n long, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_bytes = 0
        kind = None
        for batch in batches:
            shape = [batch.column(c).to_numpy() for c in ("short", "a", "b", "key")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in shape], axis=0)) + 1 if batch.num_rows else []
            # Lists of one shape are held together until there is enough to do; the last list of a batch may go on.
            for i, j in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if i == j:
                    continue
                here = tuple(int(x[i]) for x in shape)
                if held and here != kind and (here[:3] != kind[:3] or n_bytes >= LIST_BYTES):
                    yield from _walk(held, *kind[:3])
                    held, n_bytes = [], 0
                held.append(batch.slice(i, j - i))
                kind = here
                n_bytes += (j - i) * (here[0] + 40)
        if held:
            yield from _walk(held, *kind[:3])

    rows = rows.select("short", "a", "b", "key", "word", "n").repartition("key")
    return rows.sortWithinPartitions("short", "a", "b", "key", "word").mapInArrow(run, schema)


def _walk(held: list[pa.RecordBatch], short: int, a: int, b: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    words = table.column("word").to_pylist()
    key = table.column("key").to_numpy()
    counts = table.column("n").to_numpy()
    u, v = near_pairs(words, key, short, a, b)
    if not len(u):
        return
    u, v = np.concatenate((u, v)), np.concatenate((v, u))
    order = np.lexsort((v, -counts[v], u))  # within a list the smaller word comes first
    u, v = u[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    n_near = np.diff(np.append(first, len(u)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in u[first].tolist()], pa.string()),
            pa.array(n_near, pa.int64()),
            pa.array(counts[v[first]], pa.int64()),
            pa.array([words[i] for i in v[first].tolist()], pa.string()),
        ],
        names=["word", "n_near", "best_n", "best"],
    )


def near_pairs(words: list[str], key: np.ndarray, short: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word of ``short`` letters, word of as many or one more) one edit apart whose first edit lies in [a, b).

    ``words`` are sorted within each run of equal ``key``; words of different
    runs never pair.  All words have ``short`` letters or one more.
    """
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    letters = np.zeros((n, short + 2), np.uint8)  # Latin-1: a byte is a code point; 0 ends a word
    for width in (short, short + 1):
        rows = np.flatnonzero(size == width)
        if len(rows):
            raw = "".join([words[i] for i in rows.tolist()]).encode("latin-1")
            letters[rows, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    # Common prefix with the word before; -1 where a list begins.
    same = letters[1:] == letters[:-1]
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(key[1:] == key[:-1], np.argmin(same, axis=1), -1)
    far = np.int8(2)
    queries = np.flatnonzero(size == short)
    pairs_u, pairs_v = [], []
    # Ranges of words with one common prefix of ``depth`` letters, numbered in order, for each depth from a on.
    starts = [np.flatnonzero(lcp < depth) for depth in range(a, short + 2)]
    number_of = [np.cumsum(lcp < depth) - 1 for depth in range(a, short + 2)]
    for block in range(0, len(queries), QUERY_BLOCK):
        q = queries[block : block + QUERY_BLOCK]
        node = number_of[0][q]
        even = np.zeros(len(q), np.int8)  # edits when as many letters of both words are read
        ahead = np.full(len(q), far, np.int8)  # edits when one more letter of the listed word is read
        for depth in range(a, short + 1):
            here, below = starts[depth - a], starts[depth - a + 1]
            into = number_of[depth - a + 1]
            last = np.append(here[1:], n) - 1
            low = into[here[node]]
            count = into[last[node]] - low + 1
            child = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            q, even, ahead = np.repeat(q, count), np.repeat(even, count), np.repeat(ahead, count)
            letter = letters[below[child], depth]
            new_even = np.minimum(even + (letter != letters[q, depth]), far) if depth < short else np.full(len(q), far, np.int8)
            new_ahead = np.minimum(np.minimum(ahead + (letter != letters[q, depth - 1]), even + 1), far) if depth else np.minimum(even + 1, far)
            # Edits come before b; the ranges of a word that has ended hold only that word.
            keep = (np.minimum(new_even, new_ahead) < far) & (letter > 0)
            q, node, even, ahead = q[keep], child[keep], new_even[keep].astype(np.int8), new_ahead[keep].astype(np.int8)
            if depth == short - 1:
                hit = np.flatnonzero(even == 1)
                listed = starts[depth - a + 1][node[hit]]
                whole = size[listed] == short  # the shorter word of a range is its first
                pairs_u.append(q[hit[whole]])
                pairs_v.append(listed[whole])
        hit = ahead == 1
        pairs_u.append(q[hit])
        pairs_v.append(starts[short + 1 - a][node[hit]])
    u = np.concatenate(pairs_u) if pairs_u else np.zeros(0, np.int64)
    v = np.concatenate(pairs_v) if pairs_v else np.zeros(0, np.int64)
    return _first_edit_in(letters, size, u, v, short, a, b)


def _first_edit_in(letters, size, u, v, short: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first differing letter lies in [a, b), or behind the shorter word if that is where the part ends."""
    first = np.argmin(letters[u] == letters[v], axis=1)
    keep = (first >= a) & ((first < b) | ((first == short) & (b == short)))
    # A substitution is one pair from either side; the smaller word stands first.
    keep &= (size[v] > short) | (u < v)
    return u[keep], v[keep]


def spelling_groups(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    words = stage_table(vocabulary(docs), "spelling-words")
    near = near_words(words, group)
    forms = (
        words.join(near, "word", "left")
        .withColumn("best_n", -F.col("best.less"))
        .withColumn("takes", F.col("best_n") >= 2 * F.col("n"))
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("takes"), F.col("best.form")).alias("form"),
            F.when(F.col("takes"), F.col("best_n")).alias("form_n"),
        )
    )
    forms = stage_table(forms, "spelling-forms")
    ups = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("up"))
    while True:
        over = ups.select(F.col("word").alias("up"), F.col("up").alias("over"))
        ups = checkpoint(ups.join(over, "up", "left").select("word", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
        if ups.filter("moved").isEmpty():
            break
        ups = ups.drop("moved")
    return forms.join(ups.select("word", "up"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("up", "word").alias("root")
    )
