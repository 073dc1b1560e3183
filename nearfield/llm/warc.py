"""WARC archives: write one record per page, read back by boundary-chain verification.

Writing goes through Spark's text writer (a record is UTF-8 text here, the
line separator is the CRLF that ends a record), so archives land on whatever
file system the path belongs to and a lost task is simply written again.

Reading does not trust the magic string.  The reader splits archives at every
occurrence of the magic, in parallel over byte ranges; each piece is only a
*candidate* record.  A candidate whose header parses names its successor
(its own offset + header + declared length + 4).  Offsets follow from the
sizes of all pieces before it.  Pointer jumping from offset 0 of each file
keeps the reachable candidates; a magic inside a payload is never reachable
and its piece belongs to the record around it.

Defined results: a null payload is written as an empty one; a null url leaves
the target header out; records of equal payloads that tie on the smallest id
are all responses (a revisit must refer to another id); null ids order last;
an archive whose chain breaks keeps the records up to the break and the reader
reports them only; an empty table gives no archive and no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import require, stage_table

# Names and layout of the archive format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are never replaced by a revisit.
MIN_REVISIT_BYTES = 100
#: Records of one archive file.
RECORDS_PER_FILE = 20_000
#: Revisit decisions up to this many rows (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_PIECE = (
    "file string, block long, start long, size long, span long, complete boolean, record_type string, "
    "record_id string, target_uri string, refers_to string, digest string, head_length long, "
    "payload_bytes long, payload_sha256 string"
)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that are to be revisits."""
    hashed = pages.select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("payload_digest")).filter(
        F.col("n") >= MIN_REVISIT_BYTES
    )
    groups = (
        hashed.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("refers_to").isNotNull())
        .drop("copies")
    )
    return (
        hashed.join(groups, "payload_digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "payload_digest", "refers_to")
        .distinct()
    )


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as archives under ``path``."""
    pages = require(pages, {"page_id": "long", "url": "string", "html": "string"}).withColumn(
        "html", F.coalesce("html", F.lit(""))
    )
    revisits = stage_table(plan_revisits(pages), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = pages.withColumn("payload_digest", F.sha2("html", 256)).alias("p").join(
        revisits.alias("r"),
        F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.payload_digest") == F.col("r.payload_digest")),
        "left",
    )
    again = F.col("r.refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("p.html").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("p.html")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("p.page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate("p.url", "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("p.payload_digest"))),
        line("WARC-Refers-To", F.when(again, name(F.col("r.refers_to")))),
        line("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
        F.lit("\r\n"),
    )
    (
        rows.withColumn("block", block)
        .select(record.alias("value"))
        .write.option("lineSep", "\r\n")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _parse(piece: bytes) -> tuple | None:
    """(span, complete, type, id, uri, refers_to, digest, head_length, payload_bytes, sha) of a candidate piece."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = {}
    for row in piece[:cut].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()) or b"warc-type" not in fields:
        return None
    head, length = cut + 4, int(length)
    span = len(MAGIC) + head + length + 4
    complete = len(piece) >= head + length + 4
    if complete and piece[head + length : head + length + 4] != b"\r\n\r\n":
        return None
    meta = (
        fields[b"warc-type"],
        fields.get(b"warc-record-id"),
        fields.get(b"warc-target-uri"),
        fields.get(b"warc-refers-to"),
        fields.get(b"warc-payload-digest"),
        head,
    )
    size, digest = _payload_facts(piece[head : head + length], meta[0]) if complete else (None, None)
    return (span, complete, *meta, size, digest)


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head, body) if gap and head.startswith(b"HTTP/") else (b"", block)


def _payload_facts(block: bytes, kind: str) -> tuple[int, str | None]:
    """Size and SHA-256 of a payload; a revisit states the size of the one it stands for."""
    http, body = _split_http(block)
    if kind != "revisit":
        return len(body), hashlib.sha256(body).hexdigest()
    for row in http.split(b"\r\n"):
        key, _, value = row.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), None
    return 0, None


def _read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece between occurrences of the magic: value, file, block (start of its byte range)."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("value").cast("binary").alias("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches with the start of every piece, counted from the first piece of its byte range."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("value")).to_pylist()
        starts = []
        for size, file, block in zip(sizes, batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            here = at.get((file, block), 0)
            starts.append(here)
            at[file, block] = here + size + len(MAGIC)
        yield batch, starts


def _candidates(pieces: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _placed(batches):
            rows = []
            for i, start in enumerate(starts):
                piece = batch.column("value")[i].as_py()
                rows.append((start, len(piece), *(_parse(piece) or (None,) * 10)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 12
            kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *arrays], names=names)

    return pieces.mapInArrow(run, _PIECE)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which sorted offsets a chain from offset 0 visits, by pointer jumping."""
    n = len(offsets)
    jump = np.searchsorted(offsets, successors)
    there = jump < n
    there[there] = offsets[jump[there]] == successors[there]
    jump = np.where(there, jump, n)
    jump = np.append(jump, n)  # n: past the end, its own successor
    seen = np.zeros(n + 1, bool)
    seen[:-1] = offsets == 0
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        more[n] = False
        if (more == seen).all():
            return seen[:-1]
        seen, jump = more, jump[jump]


def verify_chain(candidates: DataFrame) -> DataFrame:
    """Reachable records: file, offset, and the (block, start) of their first piece.

    ``candidates`` has one small row per piece.  The byte ranges of a file give
    the base of each range by a running sum over their totals; the chain is
    followed file by file, on three integers per candidate.
    """
    totals = candidates.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    nodes = (
        candidates.filter("span is not null")
        .join(bases, ["file", "block"])
        .select("file", "block", "start", "span", (F.col("base") + F.col("start") - len(MAGIC)).alias("offset"))
        .filter("offset >= 0")
    )

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        offset = rows["offset"].to_numpy()
        return rows[reachable(offset, offset + rows["span"].to_numpy())]

    return nodes.groupBy("file").applyInPandas(chain, "file string, block long, start long, span long, offset long")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path`` that the boundary chain reaches.

    Columns: file, offset, record_type, record_id, target_uri, refers_to,
    digest (as declared), payload_bytes, payload_sha256 (computed; null for a
    revisit), and with ``payloads`` the payload as binary.  Without payloads
    only header fields and digests leave the scan.
    """
    pieces = _read_pieces(spark, path)
    found = stage_table(_candidates(pieces), "warc-candidates")
    chain = stage_table(verify_chain(found), "warc-chain")
    keys = ["file", "block", "start"]
    records = found.drop("span", "size").join(chain, keys)
    whole = records.filter("complete")
    split = stage_table(records.filter("not complete"), "warc-split")
    names = ["file", "offset", "record_type", "record_id", "target_uri", "refers_to", "digest", "payload_bytes", "payload_sha256"]
    if not payloads and split.isEmpty():
        return whole.select(*names)
    blocks = _gather(pieces, found, split if not payloads else records)
    facts = blocks.join(
        (split if not payloads else records).drop("payload_bytes", "payload_sha256"), ["file", "offset"]
    )
    body = F.expr(
        "CASE WHEN startswith(content, x'485454502f') AND position(x'0d0a0d0a' IN content) > 0 "
        "THEN substring(content, position(x'0d0a0d0a' IN content) + 4) ELSE content END"
    )
    again = F.col("record_type") == "revisit"
    stated = F.regexp_extract(F.decode(F.expr("substring(content, 1, 4096)"), "ISO-8859-1"), r"(?i)\r\nContent-Length: *([0-9]+)", 1)
    facts = (
        facts.withColumn("payload", body)
        .withColumn("stated", stated)
        .withColumn(
            "payload_bytes",
            F.when(again, F.expr("try_cast(stated AS long)")).otherwise(F.octet_length("payload").cast("long")),
        )
        .withColumn("payload_sha256", F.when(~again, F.sha2("payload", 256)))
    )
    if payloads:
        return facts.select(*names, "payload")
    return whole.select(*names).unionByName(facts.select(*names))


def _gather(pieces: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, offset, content) with the whole content block of the given records.

    A record covers its first piece and every later piece before its end, so
    each piece of the file is matched to the record of the greatest offset not
    past it; the magic that parted two pieces goes back between them.
    """
    totals = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    owners = (
        found.select("file", "block", "start", "size")
        .join(bases, ["file", "block"])
        .withColumn("at", F.col("base") + F.col("start") - len(MAGIC))
        .join(records.select("file", "block", "start", "offset", "span", "head_length"), ["file", "block", "start"], "left")
    )
    running = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owners = (
        owners.withColumn("own", F.last(F.when(F.col("offset").isNotNull(), F.struct("offset", "span", "head_length")), True).over(running))
        .filter(F.col("own").isNotNull() & (F.col("at") < F.col("own.offset") + F.col("own.span")))
        .select("file", "block", "start", "at", "own")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _placed(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=["value", "file", "block", "start"])

    parts = pieces.mapInArrow(place, "value binary, file string, block long, start long").join(owners, ["file", "block", "start"])
    joined = parts.groupBy("file", F.col("own.offset").alias("offset"), F.col("own.span").alias("span"), F.col("own.head_length").alias("head_length")).agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts")
    )
    magic = F.lit(MAGIC.encode())
    whole = F.aggregate(
        "parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, magic, x["value"])
    )
    return joined.select(
        "file",
        "offset",
        whole.alias("raw"),
        "span",
        "head_length",
    ).select(
        "file",
        "offset",
        F.expr(f"substring(raw, {len(MAGIC)} + int(head_length) + 1, int(span - head_length) - {len(MAGIC) + 4})").alias("content"),
    )


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per archived page: size and digest of its full payload, type, and the page a revisit refers to."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS long)")
    declared = F.regexp_replace("digest", "^sha256:", "")
    return read_warc(spark, path, payloads=False).select(
        number("record_id").alias("page_id"),
        F.col("payload_bytes").cast("long"),
        F.coalesce("payload_sha256", declared).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        (F.col("payload_sha256").isNull() | (F.col("payload_sha256") == declared)).alias("digest_verified"),
    )
