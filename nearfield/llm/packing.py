"""Packing tokenised documents into fixed-length sequences, harmonic classes.

The capacity C = 4096 is parted into reciprocal classes: class k holds pieces
of C/(k+1) < length <= C/k tokens and a bin of class k takes exactly k of
them.  Documents may be cut, so a document is first cut into pieces whose
lengths are themselves of the form floor(C/k) (greedily the largest that
fits), until a tail of at most ``MAX_TAIL`` tokens is left; every full bin is
then filled to at least 98 %.

Workers are independent: each task keeps one open bin per class and emits a
bin as soon as it has its k pieces.  At the end of a task the pieces of bins
still open (fewer than k per class) are laid end to end and cut at multiples of
C; the remainder is cut at powers of two, which need no padding.  No shuffle;
the state of a task is bounded by the sum of the class counts.

Defined results: a null or empty text is the single id that ends a document;
repeated rows are packed once per row; a sequence id is (task, number).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from nearfield.llm.common import bounded_batches, freeing, require
from nearfield.llm.texthash import slices

CAPACITY = 4096
END_ID = 2
MAX_TAIL = 64
#: Bytes of a task's token cache, about, before it starts anew, and the longest run kept.
CACHE_BYTES = 80 << 20
CACHE_WORD_CHARS = 48
_ENTRY_BYTES = 200  # of a cached run beside its own letters and ids
#: Text tokenised at once, in bytes: the more, the fewer times a run is looked up.
TEXT_BYTES = 2 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


class WordTokens:
    """Token ids of texts, through a cache of letter runs.

    White space always ends a token of this tokenizer, so a text's ids are
    those of its space- and newline-parted words, in order.  A word of Latin
    letters with marks after them is a letter run and a mark run to the
    tokenizer; the letter run goes straight to the tokenizer's model, whose
    ids are kept by lower-case run, so a word costs no more for its marks and
    capitals.  Any other word is encoded by the whole tokenizer.
    """

    MARKS = ".,!?;:|#*$%&()\"-"
    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = "".join(map(chr, (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))))
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {ord(c): spell(c)[0][0] for c in letters}
        self.run = re.compile(f"[{self.LETTERS}]+")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids = array("I")
        self.ends = array("q", [0, 0])
        self.held = 0

    def _encode(self, piece: str) -> array:
        if self.run.fullmatch(piece):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.spelling))])
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _pieces(self, words: pa.Array) -> pa.DictionaryArray:
        """Two pieces per word: its letter run, in lower case, and the marks after it; a word of another kind and nothing."""
        runs = pc.utf8_rtrim(words, characters=self.MARKS)
        runs = pc.if_else(pc.match_substring_regex(runs, f"^[{self.LETTERS}]*$"), runs, words)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        cuts = np.append(np.stack((offsets[:-1], offsets[:-1] + pc.binary_length(runs).to_numpy()), 1), offsets[-1])
        parts = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), words.buffers()[2] or pa.py_buffer(b""))
        coded = parts.dictionary_encode()
        found = coded.dictionary
        lower = pc.if_else(pc.match_substring_regex(found, f"^[{self.LETTERS}]+$"), pc.utf8_lower(found), found)
        return pa.DictionaryArray.from_arrays(coded.indices, lower, safe=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids end."""
        if self.held > CACHE_BYTES:
            self.clear()
        spaced = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " ")
        lists = pc.split_pattern(spaced, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        pieces = self._pieces(coded.dictionary)
        keys = pieces.dictionary.to_pylist()
        index, long_keys = self.index, []
        known = list(map(index.get, keys))
        for i in [i for i, at in enumerate(known) if at is None]:
            key = keys[i]
            at = index.get(key)  # another spelling of it in capitals may have come before
            if at is None:
                ids = self._encode(key)
                self.ids.extend(ids)
                self.held += _ENTRY_BYTES + len(key) + 4 * len(ids)
                at = index[key] = len(self.ends) - 1
                self.ends.append(len(self.ids))
                if len(key) > CACHE_WORD_CHARS:
                    long_keys.append(key)
            known[i] = at
        ends = np.frombuffer(self.ends, np.int64)
        stored = np.frombuffer(self.ids, np.uint32)
        piece = np.array(known, np.int64)[pieces.indices.to_numpy()]
        of_words, total = _laid_end_to_end(stored, ends[piece], ends[piece + 1] - ends[piece])
        del ends, stored  # the arrays can't grow while they are viewed
        for key in long_keys:
            del index[key]
        word = coded.indices.to_numpy()
        first = total[::2]
        out, total = _laid_end_to_end(of_words, first[word], np.diff(first)[word])
        return out, total[bounds[1:] - bounds[0]]


def _laid_end_to_end(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[first : first + count], and where each starts and the last one ends."""
    total = np.concatenate(([0], np.cumsum(count)))
    if not total[-1]:
        return np.zeros(0, np.uint32), total
    return ids[np.repeat(first - total[:-1], count) + np.arange(total[-1])], total


def class_lengths(capacity: int = CAPACITY, max_tail: int = MAX_TAIL) -> list[int]:
    """The cut lengths floor(capacity / k) above the tail, longest first."""
    return [capacity // k for k in range(1, capacity // max_tail + 1) if capacity // k > max_tail]


def cut(length: int, lengths: list[int]) -> list[int]:
    """Greedy cut of a document into class lengths and a tail."""
    full, rest = divmod(length, lengths[0])
    out = [lengths[0]] * full
    for size in lengths[1:]:
        while rest >= size:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class HarmonicBins:
    """Open bins of one worker; a piece is (document, start, ids)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list] = {}

    def _emit(self, pieces: list, out: list) -> None:
        offset = 0
        for doc, doc_tokens, start, ids in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.sequence, offset))
            offset += len(ids)
        for i in range(len(out) - len(pieces), len(out)):
            out[i] += (offset,)
        self.sequence += 1

    def add(self, piece: tuple, out: list) -> None:
        k = self.capacity // len(piece[3])
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self._emit(pieces, out)
            self.open[k] = []

    def close(self, out: list) -> None:
        """Pieces of open bins end to end, cut at the capacity and, at the end, at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[3]) for p in left)
        sizes = [self.capacity] * (total // self.capacity) + powers_of_two(total % self.capacity)
        queue = iter(left)
        held = None
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, doc_tokens, start, ids = held or next(queue)
                pieces.append((doc, doc_tokens, start, ids[:room]))
                held = (doc, doc_tokens, start + room, ids[room:]) if len(ids) > room else None
                room -= min(room, len(ids))
            self._emit(pieces, out)
        self.open = {}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, max_tail: int = MAX_TAIL) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text) and their places in sequences."""
    lengths = class_lengths(capacity, max_tail)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(out: list) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 36)
        out: list = []
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, ends = tokens.encode(part.column("text"))
                begin = 0
                for doc, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    own = np.append(ids[begin:end], np.uint32(END_ID)).astype("<u4")
                    begin, start = end, 0
                    for size in cut(len(own), lengths):
                        bins.add((doc, len(own), start, own[start : start + size]), out)
                        start += size
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
        bins.close(out)
        yield rows(out)

    bounded_batches(docs.sparkSession)
    return require(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, SCHEMA)
