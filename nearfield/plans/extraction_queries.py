"""Registered queries for embedding extraction (H1-H4) and IVF search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield.operators.ann import (
    build_ivf,
    build_lsh,
    ivf_search,
    load_ivf,
    load_lsh,
    lsh_search,
    save_ivf,
    save_lsh,
)
from nearfield.operators.extract import (
    extract_embeddings,
    first_parts,
    line_letter_embedder,
    split_ok,
    write_split,
)
from nearfield.operators.search import search_request
from nearfield.plans import catalog as C
from nearfield.plans.oracles import CLASS_HITS, ORACLES as BASE_ORACLES, PROTOS, R
from nearfield.plans.queries import COS, PREFILTER
from nearfield.session import scratch_path
from nearfield.sources.files import list_files, read_files, write_embeddings

N_CELLS = 8
NPROBE = 2


def _extracted(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract_embeddings(docs, line_letter_embedder, "doc_id", "text")


def extract_embeddings_flatmap(spark, sf_dir):
    """Every non-empty line of a document is one embedded part."""
    ok, _ = split_ok(_extracted(spark, sf_dir))
    return ok.select(
        "item_id",
        "part_no",
        F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
        .cast("long")
        .alias("n_letters"),
    )


MAX_LINES = 20


def extract_error_side_table(spark, sf_dir):
    """H3: items the embedder rejects, with the reason; vectors and errors come
    from one written pass of the embedder."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = extract_embeddings(docs, lambda: line_letter_embedder(MAX_LINES), "doc_id", "text")
    _, bad = write_split(got, scratch_path(spark, "extracted-sides"))
    return bad


def extract_by_path(spark, sf_dir):
    """Items keyed by a path string, as image files are: parts and letters per item."""
    items = C.table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit("img"), "source", F.col("doc_id").cast("string")).alias("image_path"), "text"
    )
    ok, _ = split_ok(extract_embeddings(items, line_letter_embedder, "image_path", "text"))
    letters = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return ok.groupBy(F.col("item_id").alias("image_path")).agg(
        F.count(F.lit(1)).cast("long").alias("n_parts"), F.sum(letters.cast("long")).alias("n_letters")
    )


def extract_to_sink(spark, sf_dir):
    """H2 + A9: extract every source folder's items, write the embeddings
    partitioned by (model, source_dir), read back per folder."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_dir"))
    ok, _ = split_ok(
        extract_embeddings(docs, line_letter_embedder, "doc_id", "text", carry=("source_dir",))
    )
    out = ok.withColumn("model", F.lit("letters26"))
    root = scratch_path(spark, "extracted")
    write_embeddings(out, root)
    back = spark.read.parquet(root)
    return back.groupBy("model", "source_dir").agg(
        F.count(F.lit(1)).cast("long").alias("n_parts"),
        F.countDistinct("item_id").cast("long").alias("n_items"),
    )


# Documents per written file of the folder queries.
FILE_ROWS = 200


def _text_folders(spark, sf_dir):
    """The documents as text files in nested folders, by language and source."""
    docs = C.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    parts = [F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")]
    root = scratch_path(spark, "text-folders")
    docs.select("text", *parts).write.partitionBy("lang", "source").option("maxRecordsPerFile", FILE_ROWS).text(root)
    spark.range(3).selectExpr("CAST(id AS STRING) AS value").write.json(f"{root}/lang=none/other")  # files of another kind
    return root


def _folder(pos: int):
    """The value in the name (``key=value``) of a folder of ``path``, from its end."""
    return F.substring_index(F.element_at(F.split("path", "/"), pos), "=", -1)


def list_files_recursive(spark, sf_dir):
    """The folders, at any depth, that hold files of a kind."""
    files = list_files(spark, _text_folders(spark, sf_dir), (".txt",))
    return files.select(_folder(-3).alias("lang"), _folder(-2).alias("source")).distinct()


def extract_from_files(spark, sf_dir):
    """A6 + H2: the files of nested folders, their bytes read in tasks and embedded line by line."""
    files = read_files(spark, _text_folders(spark, sf_dir), (".txt",))
    items = files.select("path", F.col("content").cast("string").alias("text"), _folder(-3).alias("lang"), _folder(-2).alias("source"))
    ok, _ = split_ok(extract_embeddings(items, line_letter_embedder, "path", "text", carry=("lang", "source")))
    letters = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    lines = ok.select("lang", "source", letters.cast("long").alias("n")).where("n > 0")
    return lines.groupBy("lang", "source").agg(F.count(F.lit(1)).cast("long").alias("n_lines"), F.sum("n").alias("n_letters"))


def _index(spark, coll):
    """Train, write partitioned by cell, read back (probes prune folders)."""
    path = scratch_path(spark, "ivf")
    save_ivf(build_ivf(coll, N_CELLS, max_iter=10), path)
    return load_ivf(spark, path)


def query_first_face(spark, sf_dir):
    """A10: the first embedded part of each document as its query vector."""
    ok, _ = split_ok(_extracted(spark, sf_dir))
    first = first_parts(ok)
    return first.select(
        "item_id",
        "part_no",
        F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
        .cast("long")
        .alias("n_letters"),
    )


def ivf_search_full_probe(spark, sf_dir):
    coll = C.collection(spark, sf_dir)
    index = _index(spark, coll)
    h = ivf_search(
        index, C.class_queries(coll), N_CELLS,
        rule=COS, cutoff=C.THRESHOLD, limit=C.LIMIT, id_col="vec_id",
    )
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


def ivf_prefiltered_search(spark, sf_dir):
    """A request with a scalar filter on an index, every cell probed: the exact pre-filtered hits."""
    coll = C.collection(spark, sf_dir)
    h = search_request(
        coll, C.class_queries(coll), "pgvector",
        {"certainty": C.THRESHOLD, "limit": C.LIMIT, "expr": PREFILTER, "output_fields": ["label"], "nprobe": N_CELLS},
        id_col="vec_id", index=_index(spark, coll),
    )
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank", "label")


def _class_index(spark, coll):
    """IVF whose centroids are the class prototypes (one row per class), written and read back."""
    protos = C.class_queries(coll).orderBy("query_id").collect()
    path = scratch_path(spark, "ivf-classes")
    save_ivf(build_ivf(coll, len(protos), centroids=[r["embedding"] for r in protos]), path)
    return load_ivf(spark, path)


def ivf_probe_search(spark, sf_dir):
    """Approximate search: each query reads its two nearest cells only."""
    coll = C.collection(spark, sf_dir)
    h = ivf_search(
        _class_index(spark, coll), C.class_queries(coll), NPROBE,
        rule=COS, cutoff=C.THRESHOLD, limit=C.LIMIT, id_col="vec_id",
    )
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


def knn_candidate_pool(spark, sf_dir):
    """A k-NN request with the store's own defaults (10 hits, score 0.5, pool of 100) on an index."""
    coll = C.collection(spark, sf_dir)
    h = search_request(
        coll, C.class_queries(coll), "elasticsearch", {}, id_col="vec_id", index=_class_index(spark, coll)
    )
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


LSH_BITS = 6


def lsh_search_full_probe(spark, sf_dir):
    """Hyperplane LSH with every cell probed (radius = bits) equals exact search."""
    coll = C.collection(spark, sf_dir)
    index = build_lsh(coll, LSH_BITS, dim=64)
    h = lsh_search(
        index, C.class_queries(coll), LSH_BITS,
        rule=COS, cutoff=C.THRESHOLD, limit=C.LIMIT, id_col="vec_id",
    )
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


def lsh_probe_search(spark, sf_dir):
    """Approximate search: cells within one bit flip of the query's signature, from a written index."""
    coll = C.collection(spark, sf_dir)
    path = scratch_path(spark, "lsh")
    save_lsh(build_lsh(coll, LSH_BITS, dim=64), path)
    h = lsh_search(
        load_lsh(spark, path), C.class_queries(coll), 1, rule=COS, cutoff=C.THRESHOLD, limit=C.LIMIT, id_col="vec_id"
    )
    return h.select("query_id", "vec_id", F.round("score", R).alias("score"), "rank")


QUERIES = {
    "extract_embeddings_flatmap": extract_embeddings_flatmap,
    "extract_error_side_table": extract_error_side_table,
    "extract_by_path": extract_by_path,
    "extract_to_sink": extract_to_sink,
    "list_files_recursive": list_files_recursive,
    "extract_from_files": extract_from_files,
    "query_first_face": query_first_face,
    "ivf_search_full_probe": ivf_search_full_probe,
    "ivf_prefiltered_search": ivf_prefiltered_search,
    "ivf_probe_search": ivf_probe_search,
    "knn_candidate_pool": knn_candidate_pool,
    "lsh_search_full_probe": lsh_search_full_probe,
    "lsh_probe_search": lsh_probe_search,
}

_LINES = """
lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part_no,
         unnest(string_split(text, chr(10))) AS line
  FROM documents
),
counted AS (
  SELECT doc_id, part_no, line,
         length(line) - length(regexp_replace(line, '[A-Za-z]', '', 'g')) AS n_letters
  FROM lines
),
doc_tot AS (SELECT doc_id, sum(n_letters) AS tot, count(*) AS n_lines, count(*) FILTER (WHERE line <> '') AS n_parts FROM counted GROUP BY doc_id)"""

# Cells around the class prototypes: every vector in its nearest, and each query's cells, nearest first.
_CELLS = "WITH " + PROTOS + """,
near AS (
  SELECT e.vec_id, e.embedding, p.query_id AS cell,
         row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(p.qv, e.embedding::DOUBLE[]) DESC, p.query_id) AS n
  FROM embeddings e, protos p
),
placed AS (SELECT vec_id, embedding, cell FROM near WHERE n = 1),
cell_rows AS (SELECT p.query_id AS cell, count(v.vec_id) AS n_rows FROM protos p LEFT JOIN placed v ON v.cell = p.query_id GROUP BY 1),
walk AS (
  SELECT q.query_id, q.qv, c.query_id AS cell, r.n_rows,
         list_cosine_similarity(q.qv, c.qv) AS sim
  FROM protos q, protos c JOIN cell_rows r ON r.cell = c.query_id
),
ordered AS (
  SELECT *, row_number() OVER w AS place,
         coalesce(sum(n_rows) OVER (PARTITION BY query_id ORDER BY sim DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer_rows
  FROM walk WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, cell)
)"""


def _probed(cells: str, score: str, least: float, limit: int) -> str:
    return f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT o.query_id, v.vec_id, {score} AS score FROM ordered o JOIN placed v USING (cell) WHERE {cells})
  WHERE score >= {least}
) WHERE rank <= {limit}"""


_COS = "list_cosine_similarity(o.qv, v.embedding::DOUBLE[])"
_PLANES = [[float(x) for x in row] for row in np.random.default_rng(7).standard_normal((LSH_BITS, 64))]


def _signature(v: str) -> str:
    return "(" + " + ".join(f"CASE WHEN list_dot_product({v}, {p}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(_PLANES)) + ")"


ORACLES = {
    "ivf_prefiltered_search": BASE_ORACLES["prefiltered_search"],
    "ivf_probe_search": _CELLS + _probed(f"o.place <= {NPROBE}", _COS, C.THRESHOLD, C.LIMIT),
    "knn_candidate_pool": _CELLS + _probed("o.nearer_rows < 100", f"(1 + {_COS}) / 2", 0.5, 10),
    "lsh_probe_search": "WITH " + PROTOS + f""",
sq AS (SELECT query_id, qv, {_signature('qv')} AS sig FROM protos),
se AS (SELECT vec_id, embedding, {_signature('embedding::DOUBLE[]')} AS sig FROM embeddings),
s AS (
  SELECT q.query_id, e.vec_id, list_cosine_similarity(q.qv, e.embedding::DOUBLE[]) AS score
  FROM sq q, se e WHERE bit_count(xor(q.sig, e.sig)) <= 1
)
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= {C.THRESHOLD}
) WHERE rank <= {C.LIMIT}""",
    "extract_embeddings_flatmap": "WITH " + _LINES + """
SELECT c.doc_id AS item_id, CAST(c.part_no AS BIGINT) AS part_no, CAST(c.n_letters AS BIGINT) AS n_letters
FROM counted c JOIN doc_tot t USING (doc_id)
WHERE c.line <> '' AND t.tot > 0""",
    "extract_error_side_table": "WITH " + _LINES + """
SELECT item_id, error FROM (
  SELECT doc_id AS item_id,
         CASE WHEN n_lines > {MAX_LINES} THEN 'NoFaceFound: too many lines in item'
              WHEN tot = 0 OR n_parts = 0 THEN 'NoFaceFound: no letters in item' END AS error
  FROM doc_tot
) WHERE error IS NOT NULL""".replace("{MAX_LINES}", str(MAX_LINES)),
    "extract_by_path": "WITH " + _LINES + """
SELECT 'img/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS image_path, CAST(t.n_parts AS BIGINT) AS n_parts,
       CAST(t.tot AS BIGINT) AS n_letters
FROM documents d JOIN doc_tot t USING (doc_id) WHERE t.tot > 0""",
    "list_files_recursive": """
SELECT DISTINCT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents WHERE text IS NOT NULL""",
    "extract_from_files": "WITH " + _LINES + """
SELECT coalesce(d.lang, 'none') AS lang, coalesce(d.source, 'none') AS source, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(c.n_letters) AS BIGINT) AS n_letters
FROM counted c JOIN documents d USING (doc_id) WHERE c.n_letters > 0 GROUP BY ALL""",
    "extract_to_sink": "WITH " + _LINES + """,
ok AS (
  SELECT c.doc_id FROM counted c JOIN doc_tot t USING (doc_id) WHERE c.line <> '' AND t.tot > 0
)
SELECT 'letters26' AS model, d.source AS source_dir, CAST(count(*) AS BIGINT) AS n_parts,
       CAST(count(DISTINCT ok.doc_id) AS BIGINT) AS n_items
FROM ok JOIN documents d USING (doc_id) GROUP BY d.source""",
    "query_first_face": "WITH " + _LINES + """
SELECT item_id, part_no, n_letters FROM (
  SELECT c.doc_id AS item_id, CAST(c.part_no AS BIGINT) AS part_no,
         CAST(c.n_letters AS BIGINT) AS n_letters,
         row_number() OVER (PARTITION BY c.doc_id ORDER BY c.part_no) AS rn
  FROM counted c JOIN doc_tot t USING (doc_id)
  WHERE c.line <> '' AND t.tot > 0
) WHERE rn = 1""",
    "lsh_search_full_probe": CLASS_HITS + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM hits""",
    "ivf_search_full_probe": CLASS_HITS + f"""
SELECT query_id, vec_id, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM hits""",
}
