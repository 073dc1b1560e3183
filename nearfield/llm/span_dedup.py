"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: at line breaks, after words that end in a
sentence or clause mark, and, so that every text has inner boundaries that do
not depend on where a passage was pasted, by winnowing: after the word of the
least hash (the last one of equals) in every window of ``WINDOW`` words.  A
span starts at every sentence and takes the next ones until it has
``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words.  All spans of all
documents are hashed and joined globally; every sentence covered by a span that
is not the first of its kind (in the order of document id, then place) is
removed.

Copies of a passage are cut alike except within a window of its ends, and no
sentence is longer than a window, so copies of ``MIN_WORDS + 3 * WINDOW - 1``
words (47) or more always have a span in common, whatever marks they hold and
wherever they stand.  Up to a span's rest at either end of a passage may stay.

The tasks send one hash per sentence to be counted, then the (hash, document,
place) rows of the hashes that come again; the first of each kind is a minimum,
combined before the shuffle, so a passage in a third of all documents is no hot
group.  Texts are shuffled once, to meet their removals.

Defined results: a null or empty text has no sentences and stays as it is; a
text shorter than a span stays whole; a repeated row (same id, same text) is
one document listed twice and both rows get the same result; among equal ids
the order goes on by a hash of the text; rows without an id come last; a very
long text is one slice of a task, whole, with memory of its own length; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import require, stage_table
from nearfield.llm.texthash import mix64, segment_hash, slices, split_words

MIN_SENTENCES = 3
MIN_WORDS = 24
WINDOW = 8

_MARK = np.zeros(256, bool)
_MARK[list(b".!?;:,")] = True


@dataclass
class Sentences:
    """Sentences of a slice: document, first word and word after the last, and their bytes in the slice."""

    doc: np.ndarray
    first: np.ndarray
    end: np.ndarray
    begin_byte: np.ndarray
    end_byte: np.ndarray


def winnowed(words, window: int = WINDOW) -> np.ndarray:
    """Marks the words that have the least hash of some window of words of their document, the last one of equals."""
    n = len(words.starts)
    picked = np.zeros(n, bool)
    if n >= window:
        # Backwards, so that the first least hash of a row is the last one of the window.
        rows = np.lib.stride_tricks.sliding_window_view(words.hash[::-1], window)
        doc = words.doc[::-1]
        least = np.arange(n - window + 1) + rows.argmin(1)
        picked[n - 1 - least[doc[: n - window + 1] == doc[window - 1 :]]] = True
    return picked


def split_sentences(texts: pa.Array) -> tuple[object, Sentences]:
    words = split_words(texts)
    n = len(words.starts)
    if not n:
        z = np.zeros(0, np.int64)
        return words, Sentences(z, z, z, z, z)
    breaks = np.concatenate(([0], np.cumsum(words.data == 10)))
    close = np.ones(n, bool)
    close[:-1] = (
        (words.doc[1:] != words.doc[:-1])
        | (breaks[words.starts[1:]] != breaks[words.ends[:-1]])
        | _MARK[words.data[words.ends[:-1] - 1]]
        | winnowed(words)[:-1]
    )
    end = np.flatnonzero(close) + 1
    first = np.concatenate(([0], end[:-1]))
    return words, Sentences(words.doc[first], first, end, words.starts[first], words.ends[end - 1])


def spans(words, sent: Sentences, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, number of sentences, hash, second hash) of the span that starts at each sentence, where there is one."""
    n = len(sent.doc)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    here = np.arange(n)
    # The first sentence end at or past the needed words, and at least the needed sentences.
    last = np.maximum(np.searchsorted(sent.end, sent.first + min_words), here + min_sentences - 1)
    fits = last < n
    fits[fits] = sent.doc[last[fits]] == sent.doc[fits]
    at, last = here[fits], last[fits]
    h1 = segment_hash(words.hash, sent.first[at], sent.end[last])
    h2 = segment_hash(mix64(words.hash ^ np.uint64(0x5851F42D4C957F2D)), sent.first[at], sent.end[last])
    return at, last - at + 1, h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.int32)


def _spans_table(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """(h1, h2, doc_id, key, place, length): one row per span."""
    schema = "h1 long, h2 int, doc_id long, key long, place int, length int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, sent = split_sentences(part.column("text"))
                at, length, h1, h2 = spans(words, sent, min_sentences, min_words)
                if not len(at):
                    continue
                doc = sent.doc[at]
                start = np.searchsorted(sent.doc, np.arange(words.n_docs))
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int32()),
                        part.column("doc_id").take(rows),
                        part.column("key").take(rows),
                        pa.array((at - start[doc]).astype(np.int32)),
                        pa.array(length.astype(np.int32)),
                    ],
                    names=names,
                )

    return docs.mapInArrow(run, schema)


def repeated_sentences(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, runs): per document, the (place, length) of its spans that are not the first of their kind."""
    spans_of = _spans_table(docs, min_sentences, min_words)
    # Hashes alone are counted first; only spans whose hash comes again travel with their places.
    repeated = stage_table(spans_of.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1"), "span-repeated")
    found = stage_table(spans_of.join(repeated, "h1", "left_semi"), "span-twice")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place")
    firsts = (
        found.groupBy("h1", "h2")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("h1", "h2", F.col("first.doc_id").alias("f_doc"), F.col("first.key").alias("f_key"), F.col("first.place").alias("f_place"))
    )
    firsts = stage_table(firsts, "span-firsts")
    again = found.join(firsts, ["h1", "h2"]).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("key") == F.col("f_key")) & (F.col("place") == F.col("f_place")))
    )
    return again.groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "length")).alias("runs"))


def span_dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: its text without repeated spans, and what was removed.

    Columns: doc_id, clean_text, n_sentences, n_removed, removed_words,
    removed_spans (code-point ranges of the text as ``start:end``,
    comma-joined), changed.
    """
    docs = require(docs, {"doc_id": "long", "text": "string"}).withColumn("key", F.xxhash64("text"))
    runs = stage_table(repeated_sentences(docs, min_sentences, min_words), "span-runs")
    schema = "doc_id long, clean_text string, n_sentences long, n_removed long, removed_words long, removed_spans string, changed boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, sent = split_sentences(part.column("text"))
                texts, found = part.column("text").to_pylist(), part.column("runs").to_pylist()
                edge = np.searchsorted(sent.doc, np.arange(words.n_docs + 1))
                rows = []
                for i, (text, own) in enumerate(zip(texts, found, strict=True)):
                    a, b = edge[i], edge[i + 1]
                    if not own:
                        rows.append((text, b - a, 0, 0, "", False))
                        continue
                    gone = np.zeros(b - a + 1, np.int64)
                    for run in own:
                        gone[run["place"]] += 1
                        gone[run["place"] + run["length"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    rows.append(_cut_text(text, gone, sent, a, b, words.bounds[i]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    joined = docs.alias("d").join(
        runs.alias("r"), (F.col("d.key") == F.col("r.key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left"
    )
    return joined.select("d.doc_id", "d.text", "r.runs").mapInArrow(cut, schema)


def _cut_text(text: str, gone: np.ndarray, sent: Sentences, a: int, b: int, base: int) -> tuple:
    """The text without the sentences in ``gone``; each removed run takes the white space after it along."""
    raw = text.encode("utf-8", "surrogatepass")
    step = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    kept, ranges, at, chars = [], [], 0, 0
    for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        begin, end = int(sent.begin_byte[a + i] - base), int(sent.end_byte[a + j - 1] - base)
        before = raw[at:begin].decode("utf-8", "surrogatepass")
        inside = raw[begin:end].decode("utf-8", "surrogatepass")
        chars += len(before)
        ranges.append(f"{chars}:{chars + len(inside)}")
        chars += len(inside)
        kept.append(before)
        at = end
        upto = int(sent.begin_byte[a + j] - base) if a + j < b else len(raw)
        gap = raw[end:upto].decode("utf-8", "surrogatepass")
        chars += len(gap)
        at = upto
    kept.append(raw[at:].decode("utf-8", "surrogatepass"))
    index = np.flatnonzero(gone) + a
    n_words = int((sent.end[index] - sent.first[index]).sum())
    return "".join(kept), b - a, int(gone.sum()), n_words, ",".join(ranges), True
