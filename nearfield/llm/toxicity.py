"""Toxicity: subword bags averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with boundary marks) and of the
word itself, each hashed to one of ``BUCKETS`` vectors; the word's vector is
their average and a linear softmax over (clean, toxic) reads it.  Unseen
spellings share most n-grams with seen ones.  A text is toxic when any of its
words is: with word probabilities p, the text's is 1 - prod(1 - p) in training
(labels belong to texts, so the evidence is shared among the words), and a
score is that of the text's most toxic word.  Averaging all words of a long
text instead would thin one insult out among thousands of words.

Vectors and softmax are trained together (Adagrad) on the driver from a bounded
sample of labelled rows: at most ``TRAIN_ROWS`` rows, the first in the order of
a hash of the id, whatever the length of their texts.  Tasks read the whole
texts and send the distinct words of each, which is all that training reads.
Scoring reads whole texts of all rows.  A softmax over averaged vectors needs
of every bucket only its logit, so tasks get one number per bucket (a fixed
size of 4 * BUCKETS bytes, broadcast).

Defined results: a null or empty text, or one without letters or digits,
scores 0; repeated rows score alike; with no labels of both kinds the model
is empty and every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import require
from nearfield.llm.texthash import mix64, slices

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
TRAIN_ROWS = 6_000
EPOCHS = 50
THRESHOLD = 0.7
SEED = 9

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points that belong to words: ASCII letters and digits, and all from 0xC0 on but x and division signs."""
    lower = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    return lower | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes <= 0x206F)))


@dataclass
class Bags:
    """Words of a slice of texts, and the hashed n-grams of each word."""

    doc: np.ndarray  # document of each word
    grams: np.ndarray  # buckets, word by word
    ends: np.ndarray  # end of each word's grams
    word_hash: np.ndarray
    n_docs: int


def bags(texts: pa.Array) -> Bags:
    """Hash the n-grams of every word of a column of texts."""
    texts = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    joined = "\n".join(texts.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.asarray(pc.utf8_length(texts), np.int64) + 1
    bounds = np.cumsum(lengths)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _letters(codes)
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(bounds, starts, side="right")
    n = len(starts)
    if not n:
        z = np.zeros(0, np.int64)
        return Bags(z, z, z, np.zeros(0, np.uint64), len(texts))
    # Each word with one boundary mark on either side, words one after another.
    size = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(n), size)
    place = np.arange(first[-1]) - first[word]
    marked = (place == 0) | (place == size[word] - 1)
    spelled = np.where(marked, np.uint32(1), codes[np.minimum(starts[word] + np.maximum(place - 1, 0), len(codes) - 1)])
    code = mix64(spelled.astype(np.uint64) * _STEP)
    left = size[word] - place  # symbols from here to the end of the word
    parts, owners = [], []
    rolling = code.copy()
    for width in range(2, max(GRAMS) + 1):
        rolling[: len(code) - width + 1] = rolling[: len(code) - width + 1] * _STEP + code[width - 1 :]
        if width in GRAMS:
            at = np.flatnonzero(left >= width)
            parts.append(mix64(rolling[at] + np.uint64(width)))
            owners.append(word[at])
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * (place.astype(np.uint64) * _STEP | np.uint64(1)), out=prefix[1:])
    whole = mix64(prefix[first[1:]] - prefix[first[:-1]] + size.astype(np.uint64))
    parts.append(whole)
    owners.append(np.arange(n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    grams = (np.concatenate(parts)[order] & np.uint64(BUCKETS - 1)).astype(np.int64)
    return Bags(doc, grams, np.cumsum(np.bincount(owner, minlength=n)), whole, len(texts))


@dataclass
class Model:
    """Logit of every bucket, and the bias: all that scoring needs of the trained vectors."""

    logits: np.ndarray
    bias: float
    prior: float


def _vocabulary(texts: list[str | None], step: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct words (hash), their numbers of n-grams, their buckets one after another, and (text, word) pairs.

    Texts are hashed a few at a time and only what is new of each slice is kept.
    """
    known: dict[int, int] = {}
    sizes, buckets, pair_doc, pair_word = [], [], [], []
    for at in range(0, len(texts), step):
        part = bags(pa.array(texts[at : at + step], pa.string()))
        if not len(part.doc):
            continue
        words, where, back = np.unique(part.word_hash, return_index=True, return_inverse=True)
        listed = words.tolist()
        new = np.array([i for i, word in enumerate(listed) if word not in known], np.int64)
        known.update(zip(words[new].tolist(), range(len(known), len(known) + len(new)), strict=True))
        number = np.array([known[word] for word in listed], np.int32)
        if len(new):
            starts = np.concatenate(([0], part.ends[:-1]))[where[new]]
            count = part.ends[where[new]] - starts
            total = np.cumsum(count)
            sizes.append(count)
            buckets.append(part.grams[np.repeat(starts - (total - count), count) + np.arange(total[-1])].astype(np.int32))
        pair = np.unique(part.doc * len(words) + back)
        pair_doc.append((at + pair // len(words)).astype(np.int32))
        pair_word.append(number[pair % len(words)])
    if not known:
        none = np.zeros(0, np.int32)
        return none, none, none, (none, none)
    uniq = np.fromiter(known, np.uint64, len(known))
    return uniq, np.concatenate(sizes), np.concatenate(buckets), (np.concatenate(pair_doc), np.concatenate(pair_word))


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Joint training of bucket vectors and softmax on whole-text labels."""
    labels = np.array(toxic, np.float64)
    prior = float(labels.mean()) if len(labels) else 0.0
    empty = Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    if prior in (0.0, 1.0):
        return empty
    uniq, size, flat, pairs = _vocabulary(texts)
    if not len(uniq):
        return empty
    ends = np.cumsum(size)
    used, flat = np.unique(flat, return_inverse=True)
    pair_doc, pair_word = pairs

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, DIM).astype(np.float32), np.float32(-6.0)
    sum_v, sum_w, sum_b = np.full(vectors.shape, 1e-6, np.float32), np.full(DIM, 1e-6, np.float32), 1e-6
    starts = ends - size
    flat = flat.astype(np.int32)
    cuts = [*range(0, len(uniq), 50_000), len(uniq)]  # words are averaged in groups, to bound memory
    balance = np.where(labels == 1, 0.5 / prior, 0.5 / (1 - prior))
    for _ in range(epochs):
        word_vec = np.empty((len(uniq), DIM), np.float32)
        for a, b in zip(cuts, cuts[1:], strict=False):
            word_vec[a:b] = np.add.reduceat(vectors[flat[starts[a] : ends[b - 1]]], starts[a:b] - starts[a])
        word_vec /= size[:, None]
        logit = np.clip(word_vec @ weight + bias, -30, 30).astype(np.float64)
        p = 1 / (1 + np.exp(-logit))
        # log(1 - p) summed over a text's words is log P(clean).
        clean = np.bincount(pair_doc, np.log1p(-np.minimum(p, 1 - 1e-9))[pair_word], minlength=len(labels))
        toxic_p = np.clip(-np.expm1(clean), 1e-9, 1.0)
        # d loss / d logit of a word: p for clean texts, -p (1 - P) / P for toxic ones.
        slope = np.where(labels == 1, -(1 - toxic_p) / toxic_p, 1.0) * balance
        grad = np.bincount(pair_word, slope[pair_doc], minlength=len(uniq)) * p / len(labels)
        grad = grad.astype(np.float32)
        grad_w = word_vec.T @ grad
        share = np.zeros(len(used))
        for a, b in zip(cuts, cuts[1:], strict=False):
            share += np.bincount(flat[starts[a] : ends[b - 1]], np.repeat((grad / size)[a:b], size[a:b]), minlength=len(used))
        grad_v = share.astype(np.float32)[:, None] * weight
        grad_b = float(grad.sum())
        sum_v += grad_v**2
        sum_w += grad_w**2
        sum_b += grad_b**2
        vectors -= 0.3 * grad_v / np.sqrt(sum_v)
        weight -= 0.3 * grad_w / np.sqrt(sum_w)
        bias -= np.float32(0.1 * grad_b / np.sqrt(sum_b))
    logits = np.zeros(BUCKETS, np.float32)
    logits[used] = vectors @ weight
    return Model(logits, float(bias), prior)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Score of each text: that of its most toxic word."""
    out = np.zeros(len(texts))
    found = bags(texts)
    if len(found.doc):
        starts = np.concatenate(([0], found.ends[:-1]))
        logit = np.add.reduceat(model.logits[found.grams], starts) / (found.ends - starts) + model.bias
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, found.doc, logit)
        out = 1 / (1 + np.exp(-np.clip(best, -700, 700)))
        out[np.isneginf(best)] = 0.0
    return out


def distinct_words(texts: pa.Array) -> list[str]:
    """The distinct words of each text, in lower case, at their first places' order."""
    out = []
    for text in pc.utf8_lower(texts.fill_null("").cast(pa.large_string())).to_pylist():
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = _letters(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        edge = np.diff(inside.astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
        out.append(" ".join(dict.fromkeys(text[a:b] for a, b in zip(starts, ends, strict=True))))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The bounded training sample: (text, toxic), half of it toxic where there are enough; a text is its distinct words."""
    known = (
        require(labels, {"doc_id": "long", "toxic": "int"})
        .filter("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(held_out("doc_id") == F.lit(False))
    )
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = known.filter("toxic = 1").orderBy(order).limit(rows // 2).unionByName(known.filter("toxic = 0").orderBy(order).limit(rows // 2))
    texts = require(docs, {"doc_id": "long", "text": "string"}).filter("text is not null")
    whole = texts.join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id", "text").alias("place"), "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = [part.column("place"), pa.array(distinct_words(part.column("text")), pa.string()), part.column("toxic")]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "text", "toxic"])

    return whole.mapInArrow(run, "place long, text string, toxic int").orderBy("place").limit(rows).select("text", "toxic")


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled sample, then score every document of ``docs`` (doc_id, text)."""
    sample = training_rows(docs, labels).toPandas()
    model = train(sample["text"].tolist(), sample["toxic"].astype(int).tolist())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = score_texts(model, part.column("text")) if model.logits.any() else np.full(part.num_rows, model.prior)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = require(docs, {"doc_id": "long", "text": "string"}).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
