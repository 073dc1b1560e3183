"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

Texts are cut into pieces at marks and line breaks, pieces into words.  Phrases
grow word by word.  In round k the tasks read the texts and keep, for each prefix
of k - 1 words, an associative counter: one entry per next word, and one for
all that cannot lead to a frequent phrase (the end of the piece, or a next word
whose own k - 1 words are rare).  Tasks send whole stripes (a prefix with the
arrays of its next words and counts), which are merged elementwise where the
prefix belongs.  The few prefixes that make up more than 1 / ``HOT_SHARE`` of all
words, at most ``HOT_SHARE`` of them, send their stripes in ``HOT_SLICES`` slices
by next word, so the stripe of a word that is a third of all text is no hot
group.  One merged structure gives

* the extensions: entries of at least ``MIN_COUNT`` are the phrases of k words;
* the prefix totals: the sum of a stripe is the count of its prefix, which cut
  scores take as their first parts;
* the subsumption maxima: a phrase is subsumed when the largest entry of its own
  stripe, or of the stripes that it ends (one word more in front), is as large as
  itself.

A phrase is frequent only if what it holds is, so a round needs to count only
below phrases that were frequent in the last one.  Tasks learn these from a
bitmap of fixed size (``BITMAP_BITS`` bits, whatever the corpus): a wrong hit
costs an entry that falls below ``MIN_COUNT``, never a result.  Words and
prefixes are 64-bit hashes in the tasks; should two words share one, the run
is repeated with another seed.  Strings return by joins with the last round.

Counts are exact over all texts; scores are whole numbers of up to 38 digits.

Defined results: a null text has no words and a null language is ``und``; a
repeated row counts again; ties are settled by the order of the result (score,
count, phrase in byte order) and, between cuts, by the earlier cut; texts of any
length are read whole.  Only ``text`` and ``lang`` are read, so other columns may
have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import require, stage_table
from nearfield.llm.suffix_dedup import text_bytes
from nearfield.llm.texthash import mix64, segment_hash, slices

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2_000
BITMAP_BITS = 1 << 26
HELD_ENTRIES = 300_000
HOT_SHARE = 2_000
HOT_SLICES = 256
STRIPES_PER_BATCH = 20_000

_BLOCK_BITS = 32_768  # of one bitmap block in Spark's bitmap functions
_OTHER = 0
_COUNTING = 1 << 40  # seed of the hashes that tell words of a slice apart

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class PieceWords:
    """Words of a slice: where each stands, the words that its piece has from it on, and its hash with the language's."""

    def __init__(self, texts: pa.Array, langs: list[str], seed: int):
        data, bounds = text_bytes(texts)
        self.data = _LOWER[data]
        dark = ~_GAP[data]
        before = np.zeros(len(data), bool)
        before[1:] = dark[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = dark[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(dark & ~before)
        self.ends = np.flatnonzero(dark & ~after) + 1
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        n = len(self.starts)
        marks = np.concatenate(([0], np.cumsum(_PIECE[data])))
        last = np.ones(n, bool)
        if n:
            last[:-1] = (marks[self.starts[1:]] != marks[self.ends[:-1]]) | (self.doc[1:] != self.doc[:-1])
        stop = np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1]
        self.left = stop - np.arange(n) + 1
        self.hash = word_hash(self.data, self.starts, self.ends, langs, self.doc, seed)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: list[str], doc: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each word and its language; 0 is left for "all other"."""
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    kinds = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    # Mixed once more, so that a word spelt like its language does not cancel it.
    salt = mix64(np.array([_lang_code(lang, codes) for lang in kinds], np.uint64) + np.uint64(1))
    of_doc = np.array([kinds[lang] for lang in langs], np.int64)
    words = segment_hash(codes[data], starts, ends)
    return mix64(words ^ salt[of_doc[doc]]) | np.uint64(1) if len(words) else words


def _lang_code(lang: str, codes: np.ndarray) -> int:
    raw = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8)
    return int(segment_hash(codes[raw], np.array([0]), np.array([len(raw)]))[0])


def phrase_hash(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each start on."""
    return segment_hash(words, starts, starts + k)


def _texts(docs: DataFrame) -> DataFrame:
    docs = require(docs, {"text": "string", "lang": "string"})
    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))


class _Counter:
    """Counters of a task, merged while they grow and handed on when they are many."""

    def __init__(self, keys: list[str]):
        self.keys, self.held, self.size = keys, [], 0

    def _merged(self) -> pa.Table:
        out = pa.concat_tables(self.held).group_by(self.keys).aggregate([("n", "sum")])
        return out.select([*self.keys, "n_sum"]).rename_columns([*self.keys, "n"])

    def add(self, entries: dict) -> Iterator[pa.Table]:
        entries = pa.table(entries)
        self.held.append(entries)
        self.size += len(entries)
        if self.size > 2 * HELD_ENTRIES:
            one = self._merged()
            self.held, self.size = [one], len(one)
            if self.size > HELD_ENTRIES:
                yield from self.rest()

    def rest(self) -> Iterator[pa.Table]:
        if self.held:
            yield self._merged().combine_chunks()
        self.held, self.size = [], 0


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(["lang", "word"])
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                w = PieceWords(part.column("text"), langs, _COUNTING)
                if not len(w.starts):
                    continue
                _, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                raw = w.data.tobytes()
                words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
                more = counter.add(
                    {
                        "lang": pa.array([langs[i] for i in w.doc[first].tolist()], pa.string()),
                        "word": pa.array(words, pa.string()),
                        "n": n.astype(np.int64),
                    }
                )
                for counts in more:
                    yield from counts.to_batches(max_chunksize=50_000)
        for counts in counter.rest():
            yield from counts.to_batches(max_chunksize=50_000)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed_words(words: DataFrame, seed: int) -> DataFrame:
    """(lang, word, n, next, phrase): each word with its hash as a next word and as a phrase of one word."""
    schema = "lang string, word string, n long, next long, phrase long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                data, bounds = text_bytes(part.column("word"))
                here = np.arange(part.num_rows)
                own = word_hash(data, bounds[:-1], bounds[1:], part.column("lang").to_pylist(), here, seed)
                phrase = phrase_hash(own, here, 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own.view(np.int64)), pa.array(phrase.view(np.int64))],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return words.mapInArrow(run, schema)


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """A bit per frequent phrase, of BITMAP_BITS; collected in blocks of fixed size."""
    bit = F.expr(f"phrase & {BITMAP_BITS - 1}L")
    blocks = phrases.select(F.expr(f"(phrase & {BITMAP_BITS - 1}L) DIV {_BLOCK_BITS}").alias("block"), (bit % _BLOCK_BITS).alias("bit"))
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = int(r["block"]) * (_BLOCK_BITS // 8)
        bits[at : at + _BLOCK_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _in_bitmap(bits: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    at = (phrases & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _stripe_rows(counts: pa.Table, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries (prefix, next, n) as stripes, those of hot prefixes in slices."""
    prefix, following, n = (counts.column(c).to_numpy() for c in ("prefix", "next", "n"))
    part = np.where(np.isin(prefix, hot), 1 + (following.view(np.uint64) >> np.uint64(32)).astype(np.int64) % HOT_SLICES, 0).astype(np.int32)
    order = np.lexsort((part, prefix))
    prefix, part, following, n = prefix[order], part[order], following[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]))))
    ends = np.append(first[1:], len(prefix))
    for at in range(0, len(first), STRIPES_PER_BATCH):
        heads = first[at : at + STRIPES_PER_BATCH]
        a, b = heads[0], ends[at : at + STRIPES_PER_BATCH][-1]
        offsets = pa.array(np.append(heads, b) - a, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(prefix[heads]),
                pa.array(part[heads]),
                pa.ListArray.from_arrays(offsets, pa.array(following[a:b])),
                pa.ListArray.from_arrays(offsets, pa.array(n[a:b])),
            ],
            names=["prefix", "slice", "nexts", "counts"],
        )


def _stripes(texts: DataFrame, k: int, known, seed: int) -> DataFrame:
    """(prefix, next, n): merged stripes of the prefixes of k - 1 words; next 0 holds all other continuations.

    ``known`` is a broadcast of the bitmap of frequent prefixes and of the hot ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = known.value
        counter = _Counter(["prefix", "next"])
        for batch in batches:
            for part in slices(batch, "text"):
                w = PieceWords(part.column("text"), part.column("lang").to_pylist(), seed)
                at = np.flatnonzero(w.left >= k - 1)
                prefix = phrase_hash(w.hash, at, k - 1)
                met = np.zeros(len(w.hash) + 1, bool)
                met[at] = _in_bitmap(bits, prefix)
                prefix, at = prefix[met[at]], at[met[at]]
                if not len(at):
                    continue
                goes_on = (w.left[at] >= k) & met[at + 1]
                following = np.zeros(len(at), np.uint64)
                following[goes_on] = w.hash[at[goes_on] + k - 1]
                order = np.lexsort((following, prefix))
                prefix, following = prefix[order], following[order]
                first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (following[1:] != following[:-1]))))
                entries = {
                    "prefix": prefix[first].view(np.int64),
                    "next": following[first].view(np.int64),
                    "n": np.diff(np.append(first, len(prefix))),
                }
                for counts in counter.add(entries):
                    yield from _stripe_rows(counts, hot)
        for counts in counter.rest():
            yield from _stripe_rows(counts, hot)

    stripes = texts.mapInArrow(run, "prefix long, slice int, nexts array<long>, counts array<long>").repartition("prefix", "slice")
    entries = stripes.select("prefix", "slice", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    # All stripes of a prefix's slice lie together, so the sum needs no shuffle of its own.
    return entries.groupBy("prefix", "slice", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("n")).drop("slice")


def _cuts(phrases: DataFrame) -> DataFrame:
    """(phrase, k, cut, first, rest, shorter): hashes of both parts of every cut; ``shorter`` is the phrase without its first word."""
    schema = "phrase long, cut int, first long, rest long, shorter long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.asarray(lists.value_lengths(), np.int64)
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size - 1)
            cut = np.arange(len(row)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + 1
            begin, middle, end = start[row], start[row] + cut, (start + size)[row]
            first, rest = segment_hash(flat, begin, middle), segment_hash(flat, middle, end)
            shorter = segment_hash(flat, begin + 1, end)
            yield pa.RecordBatch.from_arrays(
                [batch.column("phrase").take(pa.array(row)), pa.array(cut.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (first, rest, shorter))],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return phrases.select("phrase", "hashes").mapInArrow(run, schema)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and both parts of its lowest-scoring cut, n all
    words of the language; score is floor(1000 * a * n / (l * r)).
    """
    texts = _texts(docs)
    counted = stage_table(_word_counts(texts), "collocation-words")
    seed = 0
    while True:
        words = _hashed_words(counted, seed)
        if words.groupBy("next").count().filter("count > 1").isEmpty():
            break
        seed += 1
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    n_all = counted.agg(F.sum("n")).first()[0] or 0
    frequent = stage_table(words.filter(F.col("n") >= min_count), "collocation-frequent")
    last = frequent.select("phrase", "lang", F.array("word").alias("words"), F.array("next").alias("hashes"), F.col("n").alias("a"))
    names = frequent.select("next", "word")
    phrases, stripes = [last], []
    for k in range(2, max_words + 1):
        # At most HOT_SHARE rows: each stands for more than that share of all words.
        hot = [r["phrase"] for r in last.filter(F.col("a") * HOT_SHARE > n_all).select("phrase").collect()]
        known = texts.sparkSession.sparkContext.broadcast((_bitmap(last), np.array(hot, np.int64)))
        merged = stage_table(_stripes(texts, k, known, seed), f"collocation-stripes-{k}")
        known.unpersist()
        stripes.append(merged)
        grown = (
            merged.filter((F.col("next") != _OTHER) & (F.col("n") >= min_count))
            .join(last.select(F.col("phrase").alias("prefix"), "lang", "words", "hashes"), "prefix")
            .join(names, "next")
            .select("lang", F.concat("words", F.array("word")).alias("words"), F.concat("hashes", F.array("next")).alias("hashes"), F.col("n").alias("a"))
        )
        last = stage_table(_hashed(grown), f"collocation-phrases-{k}")
        phrases.append(last)
    candidates = reduce(DataFrame.unionByName, phrases[1:])
    counts = reduce(DataFrame.unionByName, [p.select("phrase", "a") for p in phrases])
    merged = reduce(DataFrame.unionByName, stripes)
    prefix_totals = merged.groupBy("prefix").agg(F.sum("n").alias("l"), F.max(F.when(F.col("next") != _OTHER, F.col("n"))).alias("longer"))
    cuts = stage_table(_cuts(candidates), "collocation-cuts")
    in_front = (
        cuts.filter("cut = 1").join(candidates.select("phrase", "a"), "phrase").groupBy(F.col("shorter").alias("phrase")).agg(F.max("a").alias("behind"))
    )
    kept = (
        candidates.join(prefix_totals.select(F.col("prefix").alias("phrase"), "longer"), "phrase", "left")
        .join(in_front, "phrase", "left")
        .filter("100 * greatest(coalesce(longer, 0), coalesce(behind, 0)) < 100 * a")
        .join(totals, "lang")
        .select("phrase", "lang", "words", "a", "n")
    )
    wide = "CAST({0} AS DECIMAL(38, 0))".format
    score = F.expr(f"({wide(1000)} * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})")
    scored = (
        kept.join(cuts.drop("shorter"), "phrase")
        .join(prefix_totals.select(F.col("prefix").alias("first"), "l"), "first")
        .join(counts.select(F.col("phrase").alias("rest"), F.col("a").alias("r")), "rest")
        .withColumn("score", score.cast("long"))
        .groupBy("phrase")
        .agg(
            F.min(F.struct("score", "cut", "l", "r")).alias("low"),
            F.first("lang").alias("lang"),
            F.first("words").alias("words"),
            F.first("a").alias("a"),
            F.first("n").alias("n"),
        )
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "low.l", "low.r", "n", "low.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's candidates are cut down in salted parts before they meet in one task.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    return (
        first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def _hashed(grown: DataFrame) -> DataFrame:
    """Adds the hash of each phrase over its words' hashes, as the tasks compute it."""
    schema = "phrase long, lang string, words array<string>, hashes array<long>, a long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            size = np.asarray(lists.value_lengths(), np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            end = np.cumsum(size)
            phrase = segment_hash(flat, end - size, end)
            yield pa.RecordBatch.from_arrays([pa.array(phrase.view(np.int64)), *batch.columns], names=["phrase", *batch.schema.names])

    return grown.mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces),
numbered AS (SELECT lang, w FROM lists WHERE len(w) > 0),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM numbered, (VALUES (1), (2), (3), (4), (5)) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM numbered GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k >= 2),
kept AS (
  SELECT c.* FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = c.lang AND q.k > c.k
      AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * q.a >= 100 * c.a)),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS p, array_to_string(w[cut + 1 :], ' ') AS s
  FROM (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, cut,
    (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.s
  JOIN words ON words.lang = c.lang),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest
QUALIFY rank <= 2000
"""
