"""Quality classifier by co-training of two views.

View "text" sees only what is written: hashed byte trigrams and how much words
repeat.  View "page" sees only metadata and layout: language, source, length,
lines, and the shares of capitals, digits, marks and gaps.  Both are logistic
regressions.  In each round the rows of an unlabelled pool of which one view is
surest (its likeliest of each class) get that view's pseudo-label and
join the *other* view's training rows.  After the last round each view is
calibrated (Platt) on labelled rows that neither has trained on, and the mean
of the calibrated logits scores every document.

Fitting is bounded, scoring is not: at most ``LABELLED_ROWS`` labelled and
``POOL_ROWS`` unlabelled rows, the first in the order of a hash of the id, are
reduced to feature vectors by the tasks that read them and only the vectors
reach the driver.  All documents are scored, over their whole texts, in one
pass without a shuffle.

Defined results: null text counts as empty, a null language or source as a
value of its own, a null length as 0; repeated rows score alike; with labels
of one kind only, or none, all documents are accepted with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, freeing, require
from nearfield.llm.texthash import mix64, slices, split_words

LABELLED_ROWS = 4_000
POOL_ROWS = 4_000
ROUNDS = 4
#: Pseudo-labels a view gives in one round: this share of the pool, in the classes' proportion.
ROUND_SHARE = 0.08
CONFIDENCE = 0.9
ACCEPT = 0.5
SEED = 2

TRIGRAMS = 512
TEXT_DIM = TRIGRAMS + 2
LANGS, SOURCES = 16, 32
PAGE_DIM = LANGS + SOURCES + 9

_COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _class_table() -> np.ndarray:
    """Byte classes: 0 lower or other, 1 capital, 2 digit, 3 mark of a sentence, 4 other mark, 5 gap, 6 line break."""
    kind = np.zeros(256, np.int64)
    for codes, value in (
        (range(0x21, 0x7F), 4),
        (range(0x61, 0x7B), 0),
        (range(0x41, 0x5B), 1),
        (range(0x30, 0x3A), 2),
        (b".,;:?'\"-", 3),
        (b" \t\r\x0b\x0c", 5),
        (b"\n", 6),
    ):
        kind[list(codes)] = value
    return kind


_KIND = _class_table()


def text_features(texts: pa.Array) -> np.ndarray:
    """What is written: square roots of hashed trigram shares, share of words that repeat the one before, distinct share."""
    words = split_words(texts)
    n, data = words.n_docs, words.data
    out = np.zeros((n, TEXT_DIM), np.float32)
    doc = np.repeat(np.arange(n), np.diff(words.bounds))
    if len(data) > 2:
        wide = data.astype(np.uint64)
        code = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
        at = doc[:-2] * TRIGRAMS + (mix64(code) & np.uint64(TRIGRAMS - 1)).astype(np.int64)
        count = np.bincount(at[doc[:-2] == doc[2:]], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(count / np.maximum(count.sum(1, keepdims=True), 1))
    if len(words.starts):
        total = np.maximum(np.bincount(words.doc, minlength=n), 1)
        same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        out[:, TRIGRAMS] = np.bincount(words.doc[1:][same], minlength=n) / total
        marked = np.sort((words.hash >> np.uint64(20)) + (words.doc.astype(np.uint64) << np.uint64(44)))
        new = marked[np.concatenate(([True], marked[1:] != marked[:-1]))]
        distinct = np.bincount((new >> np.uint64(44)).astype(np.int64), minlength=n)
        out[:, TRIGRAMS + 1] = np.log(np.maximum(distinct, 1)) / np.log(total + 1.0)
    return out


def _slot(values: list, size: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(repr(v).encode()) % size for v in values], np.int64)


def page_features(batch: pa.RecordBatch) -> np.ndarray:
    """Metadata and layout: language, source, length, lines, and shares of byte classes."""
    words = split_words(batch.column("text"))
    n = words.n_docs
    out = np.zeros((n, PAGE_DIM), np.float32)
    rows = np.arange(n)
    out[rows, _slot(batch.column("lang").to_pylist(), LANGS)] = 1
    out[rows, LANGS + _slot(batch.column("source").to_pylist(), SOURCES)] = 1
    doc = np.repeat(rows, np.diff(words.bounds))
    kinds = np.bincount(doc * 7 + _KIND[words.data], minlength=7 * n).reshape(n, 7)
    size = np.maximum(kinds.sum(1), 1)
    count = np.bincount(words.doc, minlength=n)
    base = LANGS + SOURCES
    chars = np.asarray(batch.column("n_chars").fill_null(0), np.float64)
    out[:, base] = np.log1p(np.maximum(chars, 0)) / 10
    out[:, base + 1] = np.log1p(kinds[:, 6]) / 5
    out[:, base + 2] = np.log1p(count / (kinds[:, 6] + 1)) / 5
    out[:, base + 3 : base + 9] = np.sqrt(kinds[:, 1:] / size[:, None])
    return out


@dataclass
class Logistic:
    """A logistic regression with its own scaling; ``slope`` and ``shift`` calibrate its logits."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.logit(x) + self.shift, -15, 15)


def _descend(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the class-balanced log loss."""
    n, dim = x.shape
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    theta, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -30, 30)))
        off = (p - y) * importance
        grad = np.append(x.T @ off + penalty * theta[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 250) -> Logistic:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    weight, bias = _descend(((x - mean) / scale).astype(np.float64), y, penalty, steps)
    return Logistic(mean, scale, weight, bias)


@dataclass
class CoTrained:
    text: Logistic | None = None
    page: Logistic | None = None
    history: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels given per round by (text, page)

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by both views together, by text, and by page."""
        if self.text is None or self.page is None:
            return np.ones(len(text)), np.ones(len(text)), np.ones(len(text))
        a, b = self.text.calibrated(text), self.page.calibrated(page)
        return tuple(1 / (1 + np.exp(-z)) for z in ((a + b) / 2, a, b))


def co_train(text: np.ndarray, page: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Train on rows with label 0 or 1; rows with label -1 are the pool."""
    known = np.flatnonzero(label >= 0)
    if len(np.unique(label[known])) < 2:
        return CoTrained()
    check = known[::4]  # calibration rows, never trained on
    start = np.setdiff1d(known, check)
    if len(np.unique(label[start])) < 2 or len(np.unique(label[check])) < 2:
        start = check = known
    views = {"text": text, "page": page}
    rows = {v: start for v in views}
    given = {v: label[start].astype(np.float64) for v in views}
    free = np.flatnonzero(label < 0)
    good = float(label[start].mean())
    model, history = {}, []
    for _ in range(rounds + 1):
        model = {v: fit_logistic(views[v][rows[v]], given[v]) for v in views}
        if len(history) == rounds or not len(free):
            break
        step, taken = max(1, int(ROUND_SHARE * (label < 0).sum())), []
        for view, other in (("text", "page"), ("page", "text")):
            p = 1 / (1 + np.exp(-np.clip(model[view].logit(views[view][free]), -30, 30)))
            order = np.argsort(p)
            bad, fine = order[: max(1, int(step * (1 - good)))], order[::-1][: max(1, int(step * good))]
            bad, fine = bad[p[bad] <= 1 - CONFIDENCE], fine[p[fine] >= CONFIDENCE]
            picked = np.concatenate((bad, fine))
            rows[other] = np.concatenate((rows[other], free[picked]))
            given[other] = np.concatenate((given[other], np.zeros(len(bad)), np.ones(len(fine))))
            taken.append(picked)
        history.append((len(taken[0]), len(taken[1])))
        free = np.delete(free, np.unique(np.concatenate(taken)))
    for view, fitted in model.items():
        z = fitted.logit(views[view][check])
        spread = max(float(z.std()), 1e-6)
        weight, bias = _descend((z / spread)[:, None], label[check].astype(np.float64), 1e-2, 200)
        fitted.slope, fitted.shift = max(float(weight[0]) / spread, 1e-6), bias
    return CoTrained(model["text"], model["page"], history)


def fitting_rows(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS, pool: int = POOL_ROWS) -> DataFrame:
    """Feature vectors of the bounded fitting sample: doc_id, label (-1: pool), text and page vectors as bytes."""
    known = (
        require(labels, {"doc_id": "long", "quality": "int"})
        .filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
    )
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    half = labelled // 2
    first = known.filter("label = 0").orderBy(*order).limit(half).unionByName(known.filter("label = 1").orderBy(*order).limit(half))
    rest = (
        require(docs, {"doc_id": "long"})
        .join(known, "doc_id", "left_anti")
        .filter("doc_id is not null")
        .orderBy(*order)
        .limit(pool)
        .withColumn("label", F.lit(-1))
    )
    picked = F.broadcast(first.unionByName(rest).groupBy("doc_id").agg(F.max("label").alias("label")))  # at most labelled + pool rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                vectors = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (text_features(part.column("text")), page_features(part))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), *vectors], names=["doc_id", "label", "text", "page"]
                )

    rows = require(docs, _COLUMNS).join(picked, "doc_id")
    return rows.mapInArrow(run, "doc_id long, label int, text binary, page binary")


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    sample = fitting_rows(docs, labels).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    if not len(sample):
        return CoTrained()
    unpack = lambda c, d: np.frombuffer(b"".join(sample[c]), np.float32).reshape(-1, d)
    return co_train(unpack("text", TEXT_DIM), unpack("page", PAGE_DIM), sample["label"].to_numpy(np.int64))


def quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Fit on the sample, then score every document of ``docs`` (the columns of ``documents``)."""
    model = fit(docs, labels)
    names = ["doc_id", "score", "text_score", "page_score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score, text, page = model.scores(text_features(part.column("text")), page_features(part))
                columns = [part.column("doc_id"), *(pa.array(x, pa.float64()) for x in (score, text, page)), pa.array(score >= accept)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return require(docs, _COLUMNS).mapInArrow(
        run, "doc_id long, score double, text_score double, page_score double, accepted boolean"
    )


def accept_documents(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` (columns of ``documents``) that the classifier accepts."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score, _, _ = model.scores(text_features(part.column("text")), page_features(part))
                yield part.filter(pa.array(score >= accept))

    return require(docs, _COLUMNS).mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
