"""Vectorised word splitting and hashing of Arrow text columns.

Words are runs of bytes outside space and 0x09-0x0D, which for UTF-8 text is
the same as the pattern ``[^\\x20\\x09-\\x0D]+``.  All arrays are numpy arrays
over one slice of a batch; a slice holds about ``SLICE_BYTES`` of text, or one
document when that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 512 << 10
SLICE_ROWS = 2_048
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        _POW = np.full(n, _BASE, np.uint64)
        _INV = np.full(n, _BASE_INV, np.uint64)
        _POW[0] = _INV[0] = 1
        np.cumprod(_POW, out=_POW)
        np.cumprod(_INV, out=_INV)
    return _POW, _INV


def segment_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run codes[start:end]; equal runs hash alike wherever they stand."""
    pw, inv = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * pw[: len(codes)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of one slice: byte ranges, the document each belongs to, and hashes."""

    data: np.ndarray  # bytes of the slice
    bounds: np.ndarray  # byte offset of each document, and the end
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # position of the document in the slice
    n_docs: int
    _hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = segment_hash(_BYTE_CODE[self.data], self.starts, self.ends)
        return self._hash


def split_words(texts: pa.Array) -> Words:
    """Split a text column (nulls count as empty) into words."""
    arr = texts.fill_null("").cast(pa.large_binary())
    n = len(arr)
    bounds = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8) if n else np.zeros(1, np.int64)
    raw = arr.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    dark = ~WHITE[data]
    before = np.zeros(len(data), bool)
    before[1:] = dark[:-1]
    inner = bounds[:-1]
    before[inner[inner < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = dark[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(dark & ~before)
    ends = np.flatnonzero(dark & ~after) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return Words(data, bounds, starts, ends, doc, n)


def slices(batch: pa.RecordBatch, column: str, size_limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its text reaches ``size_limit``, or SLICE_ROWS; whole documents stay whole."""
    col = batch.column(column)
    sizes = np.asarray(pa.compute.binary_length(col).fill_null(0), np.int64) if len(col) else np.zeros(0, np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > size_limit or i - start == SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def window_hash(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, hash) of every run of ``width`` words inside one document.

    A document with some words, but fewer than ``width``, gives one run of all its words.
    """
    n = len(words.starts)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    count = np.bincount(words.doc, minlength=words.n_docs)
    first = np.concatenate(([0], np.cumsum(count)))[words.doc]
    place = np.arange(n) - first
    size = count[words.doc]
    at = np.flatnonzero((place + width <= size) | ((place == 0) & (size < width)))
    end = np.minimum(at + width, (first + size)[at])
    return words.doc[at], at, segment_hash(words.hash, at, end)
