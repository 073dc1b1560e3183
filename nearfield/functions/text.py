"""Built-in text embedder: letter profile of a text.

A deterministic stand-in for a learned embedder that any SQL engine can
reproduce: element ``i`` is the number of occurrences of the ``i``-th letter
of the Latin alphabet, either case, in the whole text.

Spark side: an Arrow UDF that counts on the UTF-8 byte buffer of a whole
Arrow batch in one vectorised pass (ASCII letters are single bytes that never
occur inside a multi-byte UTF-8 sequence), so no Python string is created.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 26 Latin letters, in alphabet order.
LETTERS = string.ascii_lowercase

_LUT = np.full(256, -1, dtype=np.int8)
for _i, _c in enumerate(LETTERS):
    _LUT[ord(_c)] = _i
    _LUT[ord(_c.upper())] = _i

# Bytes of text counted per step (bounds the temporary arrays).
_CHUNK_BYTES = 8 << 20


def letter_counts(arr: pa.Array) -> pa.Array:
    """Arrow string array -> list<double>[26] of letter counts (NULL for NULL)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_string(arr.type):
        offsets = np.frombuffer(arr.buffers()[1], dtype=np.int32)
    else:
        offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)
    n = len(arr)
    offsets = offsets[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    counts = np.zeros((n, 26), dtype=np.int64)
    lo = 0
    while lo < n:
        # Rows lo..hi-1 whose bytes fit in one chunk (at least one row).
        hi = int(np.searchsorted(offsets, offsets[lo] + _CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        seg = _LUT[raw[offsets[lo] : offsets[hi]]]
        lens = np.diff(offsets[lo : hi + 1])
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), lens)
        keep = seg >= 0
        key = row[keep] * 26 + seg[keep]
        counts[lo:hi] = np.bincount(key, minlength=(hi - lo) * 26).reshape(hi - lo, 26)
        lo = hi
    values = pa.array(counts.reshape(-1).astype(np.float64))
    list_offsets = pa.array(np.arange(0, (n + 1) * 26, 26, dtype=np.int32))
    return pa.ListArray.from_arrays(list_offsets, values, mask=arr.is_null())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _letter_profile_udf(texts: pa.Array) -> pa.Array:
    return letter_counts(texts)


def letter_profile(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return _letter_profile_udf(t)


def letter_profile_sql(text_col: str = "text") -> str:
    """The same embedder as portable SQL text (used by the oracles)."""
    parts = [
        f"CAST(length({text_col}) - length(translate({text_col}, '{c}{c.upper()}', '')) AS DOUBLE)"
        for c in LETTERS
    ]
    return "[" + ", ".join(parts) + "]"
