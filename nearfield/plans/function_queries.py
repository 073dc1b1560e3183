"""Registered queries for the array and scalar functions (G1-G12), with their
DuckDB oracles next to them.  Inputs: ``embeddings`` (64-d), ``pages``,
``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import scalars as S
from nearfield.functions import vectors as V
from nearfield.plans import catalog as C

R = 6

# Channel constants of the image transform (ImageNet mean/std).
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]

# An 8 x 8 "image" view of a 64-d vector, cropped to rows 2..5, columns 1..4.
SIDE, Y1, Y2, X1, X2 = 8, 2, 6, 1, 5
BOX_W = 20  # image width for the box clip


def _emb(spark, sf_dir):
    return C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _round_arr(col):
    return F.transform(col, lambda x: F.round(x, R))


def l2_normalise(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", _round_arr(V.l2_normalize("embedding")).alias("v"))


def minmax_scale(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", _round_arr(V.minmax_scale("embedding")).alias("v"))


def channel_standardise(spark, sf_dir):
    v = V.standardise("embedding", CHANNEL_MEAN, CHANNEL_STD)
    return _emb(spark, sf_dir).select("vec_id", _round_arr(v).alias("v"))


def scalar_quantise(spark, sf_dir):
    return _emb(spark, sf_dir).select(
        "vec_id", V.quantise_u8(V.minmax_scale("embedding")).alias("q")
    )


def box_clip(spark, sf_dir):
    e = _emb(spark, sf_dir)
    x = F.round(F.element_at(V.as_double("embedding"), 1) * 100).cast("int")
    w = F.round(F.abs(F.element_at(V.as_double("embedding"), 2)) * 100).cast("int")
    lo, hi = S.clip_box(x, w, F.lit(BOX_W))
    return e.select("vec_id", x.alias("x"), w.alias("w"), lo.alias("x_min"), hi.alias("x_max"))


def _as_rows(col):
    d = V.as_double(col)
    return F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda r: F.slice(d, r * SIDE + 1, SIDE))


def subarray_crop(spark, sf_dir):
    crop = V.crop2d(_as_rows("embedding"), F.lit(Y1), F.lit(Y2), F.lit(X1), F.lit(X2))
    return _emb(spark, sf_dir).select("vec_id", F.flatten(crop).alias("crop"))


def flatten_array(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", F.flatten(_as_rows("embedding")).alias("flat"))


def struct_array_field(spark, sf_dir):
    faces = F.transform(
        V.as_double("embedding"), lambda x, i: F.struct(i.alias("pos"), x.alias("val"))
    )
    return _emb(spark, sf_dir).select("vec_id", faces.getField("val").alias("vals"))


def json_vector_roundtrip(spark, sf_dir):
    e = _emb(spark, sf_dir)
    back = V.json_to_vector(V.vector_to_json("embedding"))
    return e.select("vec_id", F.transform(back, lambda x: F.round(x, 6)).alias("vals"))


def path_scalars(spark, sf_dir):
    p = C.table(spark, sf_dir, "pages").select("page_id", "url")
    name = S.base_name("url")
    return p.select(
        "page_id",
        name.alias("base_name"),
        F.lower(name).alias("base_lower"),
        S.has_suffix_ci("url", (".html",)).alias("is_html"),
        F.length("url").cast("long").alias("url_len"),
    )


def timestamp_text(spark, sf_dir):
    ev = C.table(spark, sf_dir, "events").select("event_id", "ts")
    txt = S.ts_file_text("ts")
    return ev.select(
        "event_id",
        txt.alias("ts_text"),
        S.epoch_seconds(S.ts_from_file_text(txt)).alias("ts_seconds"),
    )


QUERIES = {
    "l2_normalise": l2_normalise,
    "minmax_scale": minmax_scale,
    "channel_standardise": channel_standardise,
    "scalar_quantise": scalar_quantise,
    "box_clip": box_clip,
    "subarray_crop": subarray_crop,
    "flatten_array": flatten_array,
    "struct_array_field": struct_array_field,
    "json_vector_roundtrip": json_vector_roundtrip,
    "path_scalars": path_scalars,
    "timestamp_text": timestamp_text,
}

# -- oracles -------------------------------------------------------------------------

_E = "embedding::DOUBLE[]"
_MM = f"list_transform({_E}, lambda x: (x - list_min({_E})) / (list_max({_E}) - list_min({_E})))"
_MEAN = "[" + ", ".join(str(x) for x in CHANNEL_MEAN) + "]"
_STD = "[" + ", ".join(str(x) for x in CHANNEL_STD) + "]"
_ROWS = "[" + ", ".join(
    f"list_slice({_E}, {r * SIDE + 1}, {r * SIDE + SIDE})" for r in range(SIDE)
) + "]"
_CROP = "flatten([" + ", ".join(
    f"list_slice({_E}, {r * SIDE + X1 + 1}, {r * SIDE + X2})" for r in range(Y1, Y2)
) + "])"

ORACLES = {
    "l2_normalise": f"""
SELECT vec_id, list_transform({_E}, lambda x: round(x / sqrt(list_sum(list_transform({_E}, lambda y: y * y))), {R})) AS v
FROM embeddings""",
    "minmax_scale": f"""
SELECT vec_id, list_transform({_MM}, lambda x: round(x, {R})) AS v FROM embeddings""",
    "channel_standardise": f"""
SELECT vec_id, list_transform({_E}, lambda x, i: round((x - {_MEAN}[((i - 1) % 3) + 1]) / {_STD}[((i - 1) % 3) + 1], {R})) AS v
FROM embeddings""",
    "scalar_quantise": f"""
SELECT vec_id, list_transform({_MM}, lambda x: CAST(least(greatest(round(x * 255.0), 0.0), 255.0) AS INTEGER)) AS q
FROM embeddings""",
    "box_clip": f"""
SELECT vec_id, x, w, greatest(0, x) AS x_min, least({BOX_W}, greatest(0, x) + w) AS x_max
FROM (SELECT vec_id, CAST(round(embedding[1]::DOUBLE * 100) AS INTEGER) AS x,
             CAST(round(abs(embedding[2]::DOUBLE) * 100) AS INTEGER) AS w FROM embeddings)""",
    "subarray_crop": f"SELECT vec_id, {_CROP} AS crop FROM embeddings",
    "flatten_array": f"SELECT vec_id, flatten({_ROWS}) AS flat FROM embeddings",
    "struct_array_field": f"SELECT vec_id, {_E} AS vals FROM embeddings",
    "json_vector_roundtrip": f"SELECT vec_id, list_transform({_E}, lambda x: round(x, 6)) AS vals FROM embeddings",
    "path_scalars": """
SELECT page_id, string_split(url, '/')[-1] AS base_name, lower(string_split(url, '/')[-1]) AS base_lower,
       lower(url) LIKE '%.html' AS is_html, CAST(length(url) AS BIGINT) AS url_len
FROM pages""",
    "timestamp_text": """
SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS ts_text,
       CAST(epoch(strptime(strftime(ts, '%Y-%m-%d_%H-%M-%S'), '%Y-%m-%d_%H-%M-%S')) AS BIGINT) AS ts_seconds
FROM events""",
}
