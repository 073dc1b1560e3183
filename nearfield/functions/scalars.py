"""Scalar helpers on paths, boxes, timestamps and batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source format.
# Timestamp text in result and output file names: %Y-%m-%d_%H-%M-%S.
TS_FILE_FORMAT = "yyyy-MM-dd_HH-mm-ss"
# Image suffixes accepted by the recursive file listing (case-insensitive).
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".gif")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path) -> Column:
    """Text after the last ``/`` (``''`` for a path ending in ``/``)."""
    return F.element_at(F.split(_c(path), "/"), -1)


def non_empty(x) -> Column:
    return _c(x).isNotNull() & (_c(x) != F.lit(""))


def has_suffix_ci(path, suffixes=IMAGE_SUFFIXES) -> Column:
    """Case-insensitive suffix test."""
    low = F.lower(_c(path))
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | low.endswith(s)
    return cond


def database_from_file_name(name) -> Column:
    """Part after the last ``_database_`` up to the next ``_``."""
    tail = F.element_at(F.split(_c(name), "_database_"), -1)
    return F.element_at(F.split(tail, "_"), 1)


def capitalize(s) -> Column:
    """Upper first character, lower the rest (F8)."""
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def two_decimals(x) -> Column:
    return F.format_string("%.2f", _c(x))


def ts_file_text(ts) -> Column:
    """Timestamp as ``yyyy-MM-dd_HH-mm-ss``."""
    return F.date_format(_c(ts), TS_FILE_FORMAT)


def ts_from_file_text(s) -> Column:
    """Inverse of ``ts_file_text`` as a zone-less timestamp (no session-zone shift)."""
    return F.to_timestamp_ntz(_c(s), F.lit(TS_FILE_FORMAT))


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 of a zone-less timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def seconds_between(start, end) -> Column:
    """``end - start`` in seconds as double, microsecond exact and independent
    of the session time zone (E4)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1_000_000.0)


def clip_box(x, w, limit) -> tuple[Column, Column]:
    """Crop bounds of a box clamped to ``[0, limit]``.

    As in the source, the upper bound adds the width to the already clamped
    start, so a box starting left of the image keeps its full width.
    """
    lo = F.greatest(F.lit(0), _c(x))
    hi = F.least(_c(limit), lo + _c(w))
    return lo, hi


def batch_number(pos, batch_size: int = 500) -> Column:
    """0-based batch of a 0-based position."""
    return F.floor(_c(pos) / F.lit(int(batch_size))).cast("long")


def batch_count(n, batch_size: int = 500) -> Column:
    return F.ceil(_c(n) / F.lit(int(batch_size))).cast("long")
