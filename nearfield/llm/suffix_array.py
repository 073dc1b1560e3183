"""Suffix arrays of one shard by induced sorting, in numpy.

A shard is a list of byte strings.  Positions are classified as S (the suffix is
smaller than the next one) or L; the leftmost S of each run of S starts an LMS
substring.  One inducing pass sorts the LMS substrings, equal ones get equal
names, the string of names is sorted in turn, and a second pass induces the order
of all suffixes from that of the LMS suffixes.  A pass walks the buckets of first
symbols and moves all suffixes that a bucket holds so far in one array operation,
so its Python steps grow with the alphabet and the longest run of one symbol, not
with the text.  The string of names has an alphabet as large as itself; it is
sorted by ranks of three, nine, ... names until they reach past the longest
string of the shard: what lies behind the end of a string never decides.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 258  # end of the shard, end of a string, 256 bytes


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of S type; a run of one symbol takes the type at its end."""
    n = len(text)
    here = np.arange(n, dtype=np.int32)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    # Position of the last symbol of the run that each position lies in.
    last = np.minimum.accumulate(np.where(differs, here, n)[::-1])[::-1]
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    s = rises[last]
    s[-1] = True
    return s


def _move(text: np.ndarray, at: np.ndarray, place: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Append the suffixes ``at``, in their order, to their buckets at ``place`` (fronts, or backs when step is -1)."""
    symbols = text[at]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    count = np.bincount(symbols, minlength=_SYMBOLS)
    # Each bucket's share starts at its place; the rest of the shares follow in steps.
    shift = place - step * (np.cumsum(count) - count)
    sa[shift[symbols] + step * np.arange(len(at))] = at[order]
    place += step * count


def _induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes given in order."""
    n = len(text)
    size = np.bincount(text, minlength=_SYMBOLS)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int32)
    n_lms = np.bincount(text[lms], minlength=_SYMBOLS)
    # L: buckets upwards; the LMS suffixes of a bucket come after its L suffixes.
    first_lms = np.cumsum(n_lms) - n_lms
    front = start.copy()
    for c in np.flatnonzero(size):
        done = start[c]
        while done < front[c]:
            chunk = sa[done : front[c]] - 1
            done = front[c]
            chunk = chunk[chunk >= 0]
            chunk = chunk[~s_type[chunk]]
            if len(chunk):
                _move(text, chunk, front, sa, 1)
        if n_lms[c]:
            chunk = lms[first_lms[c] : first_lms[c] + n_lms[c]] - 1
            chunk = chunk[chunk >= 0]  # the symbol before an LMS suffix is of L type
            if len(chunk):
                _move(text, chunk, front, sa, 1)
    # S: buckets downwards, from their backs; the shard's end is the smallest suffix.
    back = end - 1
    sa[0] = n - 1
    for c in np.flatnonzero(size)[::-1]:
        done = end[c]
        while done > back[c] + 1:
            chunk = sa[back[c] + 1 : done][::-1] - 1
            done = back[c] + 1
            chunk = chunk[chunk >= 0]
            chunk = chunk[s_type[chunk]]
            if len(chunk):
                _move(text, chunk, back, sa, -1)
        chunk = sa[start[c] : front[c]][::-1] - 1
        chunk = chunk[chunk >= 0]
        chunk = chunk[s_type[chunk]]
        if len(chunk):
            # A predecessor of an L suffix that is itself S has a smaller symbol, so this bucket is complete.
            _move(text, chunk, back, sa, -1)
    sa[0] = n - 1
    return sa


def _names(text: np.ndarray, lms: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order; equal substrings share a name, names keep their order."""
    n = len(text)
    index = np.full(n, -1, np.int32)
    index[lms] = np.arange(len(lms), dtype=np.int32)
    inner = sa[index[sa] >= 0]  # LMS positions, by their substrings
    stop = np.append(lms[1:], n - 1)
    length = stop - lms + 1
    a, b = inner[:-1], inner[1:]
    size = length[index[a]]
    same = size == length[index[b]]
    open_, at = np.flatnonzero(same), 0
    while len(open_):
        same[open_] = text[a[open_] + at] == text[b[open_] + at]
        at += 1
        open_ = open_[same[open_] & (size[open_] > at)]
    names = np.empty(len(lms), np.int64)
    names[index[inner]] = np.concatenate(([0], np.cumsum(~same)))
    return names, int(names.max()) + 1 if len(names) else 0


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the string of names, by their next ``depth`` names."""
    rank, reach, n = names + 1, 1, len(names)
    while True:
        top = int(rank.max()) + 1
        parts = 3 if top < 1 << 20 else 2
        key = rank.copy()
        for k in range(1, parts):
            key *= top
            if k * reach < n:
                key[: n - k * reach] += rank[k * reach :]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        reach *= parts
        if new.all() or reach >= depth:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)


def suffix_array(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, text position of each string's start) for the strings laid end to end in ``data``.

    ``order`` lists the suffixes of all strings in the shard's own text, where
    one end symbol follows each string.  Suffixes that are equal up to the end
    of their strings stand next to each other in some order.
    """
    ends = np.cumsum(lengths)
    number = np.repeat(np.arange(len(lengths)), lengths)
    text = np.ones(len(data) + len(lengths) + 1, np.int16)
    text[np.arange(len(data)) + number] = data.astype(np.int16) + 2
    text[-1] = 0
    s_type = _types(text)
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    sa = _induce(text, s_type, by_symbol)
    names, n_names = _names(text, lms, sa)
    if n_names < len(lms):
        # A string holds an LMS position in every two bytes at most, and one more at its end.
        order = _sort_names(names, int(lengths.max()) // 2 + 2)
    else:
        order = np.argsort(names)
    sa = _induce(text, s_type, lms[order])
    return sa, ends - lengths + np.arange(len(lengths))


def common_prefixes(data: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, plcp): for each position of ``data``, the suffix before its own in the order, and their common prefix.

    Prefixes end with their strings.  Only positions whose predecessor does not
    extend the same match are compared; the others follow by one less.
    """
    n = len(data)
    here = np.arange(n, dtype=np.int32)
    number = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    end = np.repeat(np.cumsum(lengths).astype(np.int32), lengths)
    to_data = np.full(len(order), -1, np.int32)
    to_data[here + number] = here
    at = to_data[order]
    at = at[at >= 0]
    previous = np.full(n, -1, np.int32)
    previous[at[1:]] = at[:-1]
    follows = np.zeros(n, bool)
    if n > 1:
        p = previous[1:]
        at = np.flatnonzero((p > 0) & (previous[:-1] == p - 1) & (end[:-1] == end[1:])) + 1
        before = previous[at] - 1
        follows[at] = (end[before] == end[before + 1]) & (data[at - 1] == data[before])
    start = np.flatnonzero(~follows & (previous >= 0))
    lcp = np.zeros(n, np.int32)
    most = np.minimum(end[start] - start, end[previous[start]] - previous[start])
    lcp[start] = _match(data, start, previous[start], most)
    # plcp + position is constant while matches are carried on.
    source = np.maximum.accumulate(np.where(follows, 0, here))
    return previous, np.maximum((lcp + here)[source] - here, 0)


def _match(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of data[a:] and data[b:], at most ``most``; eight bytes a step."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded.tobytes(), strides=(1,))
    out = most.copy()
    open_, at = np.flatnonzero(most > 0), 0
    while len(open_):
        diff = eight[a[open_] + at] ^ eight[b[open_] + at]
        hit = diff != 0
        ends = open_[hit]
        if len(ends):
            d = diff[hit]
            low = d & (~d + np.uint64(1))
            same = np.zeros(len(d), np.int32)
            for k in range(1, 8):
                same += low >= np.uint64(1 << (8 * k))
            out[ends] = np.minimum(at + same, most[ends])
        at += 8
        open_ = open_[~hit]
        open_ = open_[most[open_] > at]
    return out
