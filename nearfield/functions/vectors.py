"""Vector arithmetic as Spark Column expressions (JVM side, no Python).

Rules shared by every scorer in the library (the Arrow scorer applies the
same ones before its matrix product):

* arithmetic is done in double, whatever the stored element type;
* a NULL vector, a NULL element, or vectors of unequal length give a NULL
  score (``zip_with`` pads the shorter side with NULL, which propagates);
* a zero vector gives NULL (``try_divide`` instead of an ANSI error);
* NaN becomes NULL, because in Spark ``NaN >= c`` is true for every ``c``.

A NULL score is never a hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    """Element-wise cast of an array to ``array<double>``."""
    return _c(v).cast("array<double>")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Inner product; NULL when lengths differ or an element is NULL."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def sq_norm(v) -> Column:
    return _sum(F.transform(as_double(v), lambda x: x * x))


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def cosine(a, b) -> Column:
    """Cosine similarity with the NULL rules of this module."""
    s = F.try_divide(dot(a, b), F.sqrt(sq_norm(a) * sq_norm(b)))
    return nan_to_null(s)


def inner_product(a, b) -> Column:
    return nan_to_null(dot(a, b))


def sq_l2(a, b) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return nan_to_null(_sum(d))


def l2_distance(a, b) -> Column:
    return F.sqrt(sq_l2(a, b))


def l2_normalize(v) -> Column:
    """``v / |v|``; a zero or NULL vector gives NULL (G1)."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n))


def minmax_scale(v) -> Column:
    """``(x - min) / (max - min)``; a constant vector gives NULL elements."""
    d = as_double(v)
    lo, hi = F.array_min(d), F.array_max(d)
    return F.transform(d, lambda x: F.try_divide(x - lo, hi - lo))


def standardise(v, mean: list[float], std: list[float]) -> Column:
    """Per-position ``(x - mean[i]) / std[i]``; the constants repeat cyclically
    over the vector, as channel constants do over an interleaved tensor (G3)."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    k = len(mean)
    return F.transform(
        as_double(v),
        lambda x, i: (x - F.element_at(m, F.pmod(i, F.lit(k)) + 1))
        / F.element_at(s, F.pmod(i, F.lit(k)) + 1),
    )


def quantise_u8(v) -> Column:
    """``round(x * 255)`` clamped to 0..255 (G4).  The source wraps modulo 256
    on uint8 input; that overflow is not reproduced."""
    return F.transform(
        as_double(v),
        lambda x: F.least(F.greatest(F.round(x * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int"),
    )


def vector_to_json(v) -> Column:
    """JSON text of a float array."""
    return F.to_json(as_double(v))


def json_to_vector(s) -> Column:
    return F.from_json(_c(s), "array<double>")


def crop2d(rows, y1, y2, x1, x2) -> Column:
    """``img[y1:y2, x1:x2]`` on an array of arrays with 0-based, end-exclusive
    bounds (G7)."""
    r = F.slice(_c(rows), _c(y1) + 1, _c(y2) - _c(y1))
    return F.transform(r, lambda row: F.slice(row, _c(x1) + 1, _c(x2) - _c(x1)))


def dim_ok(v, dim: int) -> Column:
    """``size(v) = dim`` check used by collection writes."""
    return F.size(_c(v)) == F.lit(int(dim))


# -- packed storage ----------------------------------------------------------------
# A vector can be stored as ``binary``: little-endian float32, 4 * dim bytes.
# The Arrow scorer reads it without per-element conversion (about half the
# scan cost of ``array<float>``).  NULL stays NULL.


@F.arrow_udf(T.BinaryType())
def _pack_f32(v: pa.Array) -> pa.Array:
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    v = v.cast(pa.list_(pa.float32()))
    lens = np.where(v.is_null().to_numpy(zero_copy_only=False), 0, v.value_lengths().fill_null(0).to_numpy())
    flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), dtype="<f4")
    offs = np.zeros(len(v) + 1, dtype=np.int32)
    np.cumsum(lens * 4, out=offs[1:])
    validity = pa.array(~v.is_null().to_numpy(zero_copy_only=False)).buffers()[1]
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(v), [validity, pa.py_buffer(offs), pa.py_buffer(flat.tobytes())]
    )


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unpack_f32(b: pa.Array) -> pa.Array:
    if isinstance(b, pa.ChunkedArray):
        b = b.combine_chunks()
    b = b.cast(pa.binary())
    n = len(b)
    # A length that is no multiple of 4 is no vector: NULL, like a NULL row.
    lens = np.asarray(pc.binary_length(b).fill_null(-1).to_numpy(zero_copy_only=False))
    bad = (lens < 0) | (lens % 4 != 0)
    good = b.filter(pa.array(~bad))
    raw = b"".join(x.as_buffer() for x in good) if len(good) else b""
    list_offs = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.where(bad, 0, lens // 4), out=list_offs[1:])
    return pa.ListArray.from_arrays(
        pa.array(list_offs), pa.array(np.frombuffer(raw, dtype="<f4")), mask=pa.array(bad)
    )


def pack_f32(v) -> Column:
    """``array<float|double>`` -> packed float32 ``binary``."""
    return _pack_f32(_c(v))


def unpack_f32(b) -> Column:
    """Packed float32 ``binary`` -> ``array<float>``; NULL where the length is no multiple of 4."""
    return _unpack_f32(_c(b))
