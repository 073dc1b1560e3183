"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns (email, ip, card, phone) give the seed entities.  Every word with
a digit or an at sign that no base span covers is a candidate identifier.  The
words around seeds and candidates are lexical patterns: the word before, and
the word after.  Patterns and instances form a bipartite graph that is scored
in rounds: a pattern's confidence is the share of its distinct instances that
are known identifiers, weighed by how many it has; an instance's score is
1 - prod(1 - confidence) over its patterns; instances above a bar
become known and the next round rescores the patterns.  Spans of discovered
instances join the base spans under the kind ``id``; base spans stay as they are.

Positions count code points.  A pattern's matches are found by splitting the
text at the pattern: the pieces and the matches alternate, so running lengths
give the positions.

Defined results: a null or empty text has no spans and the digest of the
empty string; repeated rows give repeated results; without seeds nothing is
discovered; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import documents_like, require, stage_table

KINDS = ("email", "ip", "card", "phone")
FOUND_KIND = "id"

# What the base patterns match.  Possessive quantifiers and the
# guards in front only spare the matcher hopeless starts; the matches are those
# of the plain patterns
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+
#   \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every match of a kind passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A candidate identifier: a word part of at least six characters with a digit, without trailing marks.
CANDIDATE = r"(?<![^\s\"'=:(,;<>\[\]{}])(?=[^\s\"'=:(,;<>\[\]{}]*[0-9])[A-Za-z0-9][A-Za-z0-9@._/+-]{4,62}[A-Za-z0-9](?![A-Za-z0-9@_/+-])"

ROUNDS = 3
#: A pattern counts from this many distinct known instances on; an instance becomes known at this score.
MIN_SUPPORT = 3
ACCEPT = 0.75


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def value(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, doubled(d)).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


_MATCH = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _walk(pieces: Column, found: Column) -> Column:
    """Array of (start, end, match, before, after): matches with their places and the pieces around them.

    ``pieces`` are the text's parts between the matches, one more than there are
    matches; only the 80 code points nearest the match are kept of a piece.
    """
    n = F.size(found)
    around = F.zip_with(
        F.zip_with(found, F.slice(pieces, 1, n), lambda m, b: F.struct(m.alias("m"), b.alias("b"))),
        F.slice(pieces, 2, n),
        lambda x, a: F.struct(x["m"].alias("m"), x["b"].alias("b"), a.alias("a")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(
            start.alias("start"), end.alias("end"), x["m"].alias("match"),
            F.right(x["b"], F.lit(80)).alias("before"), F.left(x["a"], F.lit(80)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.array().cast(_MATCH)
    walked = F.aggregate(around, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(n > 0, walked).otherwise(none)


def _base_spans(kind: str, rank: int) -> Column:
    """The valid matches of a kind, with its rank after the start."""
    return F.transform(
        F.filter(f"m_{kind}", lambda x: _valid(kind, x["match"])),
        lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], x["match"], x["before"], x["after"]),
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, base, candidates): base spans and candidate words of every row, written once.

    ``base`` holds (start, rank of the kind, end, match, before, after),
    ``candidates`` the same without a rank; ``key`` is a hash of the row.
    """
    rows = require(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    searches = {**{k: (PATTERNS[k], HINTS[k]) for k in KINDS}, "candidate": (CANDIDATE, "[0-9]")}
    columns = []
    for name, (pattern, hint) in searches.items():
        there = F.regexp("text", F.lit(hint))
        columns.append(F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"f_{name}"))
        columns.append(F.when(there, F.split("text", pattern, -1)).alias(f"p_{name}"))
    rows = rows.select("doc_id", _row_key().alias("key"), *columns)
    rows = rows.select("doc_id", "key", *[_walk(F.col(f"p_{n}"), F.col(f"f_{n}")).alias(f"m_{n}") for n in searches])
    ranked = [_base_spans(kind, rank) for rank, kind in enumerate(KINDS)]
    rows = rows.select("doc_id", "key", F.array_sort(F.concat(*ranked)).alias("base"), "m_candidate")
    covered = lambda c: F.exists("base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"]))
    return stage_table(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "key",
            "base",
            F.filter("m_candidate", lambda c: ~covered(c)).alias("candidates"),
        ),
        "pii-spans",
    )


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _word(column: Column, side: str) -> Column:
    """The word nearest the span, lower-cased and without marks; empty if there is none."""
    near = F.regexp_extract(column, r"(\S+)[\s\"'(\[=:]*$" if side == "L" else r"^[\s\"').,;:\]]*(\S+)", 1)
    return F.regexp_replace(F.lower(near), r"[^\p{L}\p{N}]+", "")


def _edges(spans: DataFrame) -> DataFrame:
    """(pattern, instance, seed): which lexical patterns stand around which words."""
    one = lambda column, seed: spans.select(F.explode(column).alias("s")).select(
        F.col("s.match").alias("instance"), F.col("s.before").alias("before"), F.col("s.after").alias("after"), F.lit(seed).alias("seed")
    )
    both = one("base", True).unionByName(one("candidates", False))
    left, right = _word(F.col("before"), "L"), _word(F.col("after"), "R")
    patterns = F.array(F.concat(F.lit("L "), left), F.concat(F.lit("R "), right))
    return (
        both.select("instance", "seed", F.explode(patterns).alias("pattern"))
        .filter(F.length("pattern") > 2)
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"))
    )


def discover(spans: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(instance): identifiers that no base pattern knows, found through the patterns of known ones.

    Patterns and instances are aggregated by counts and sums only; a pattern
    next to a third of all identifiers is one key with combined partial counts.
    """
    edges = stage_table(_edges(spans), "pii-edges")
    known = edges.filter("seed").select("instance").distinct()
    found = None
    for _ in range(rounds):
        marked = edges.join(known.withColumn("known", F.lit(1)), "instance", "left").withColumn("known", F.coalesce("known", F.lit(0)))
        scored = (
            marked.groupBy("pattern")
            .agg(F.sum("known").alias("hits"), F.count("*").alias("all"))
            .filter(F.col("hits") >= min_support)
            # Few instances say little: the share is drawn towards zero by one miss.
            .select("pattern", (F.col("hits") / (F.col("all") + 1)).alias("confidence"))
        )
        reached = (
            edges.filter("not seed")
            .join(scored, "pattern")
            .groupBy("instance")
            .agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("miss"))
            .filter(1 - F.exp("miss") >= accept)
            .select("instance")
        )
        found = stage_table(reached, "pii-found")
        known = edges.filter("seed").select("instance").distinct().unionByName(found).distinct()
    return found


def _joined(spans: Column, names: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


_PLACES = "array<struct<start:int,rank:int,end:int>>"


def all_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, key, base, places) per row: base spans, and all spans with the discovered ones, in order."""
    spans = find_spans(docs)
    found = discover(spans, rounds)
    place = lambda x, rank: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"))
    extra = (
        spans.select("row", F.explode("candidates").alias("c"))
        .select("row", F.col("c.match").alias("instance"), place(F.col("c"), F.lit(len(KINDS))).alias("place"))
        .join(found, "instance")
        .groupBy("row")
        .agg(F.collect_list("place").alias("extra"))
    )
    base = F.transform("base", lambda x: place(x, x["rank"]))
    return (
        spans.select("row", "doc_id", "key", base.alias("base"))
        .join(extra, "row", "left")
        .select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_PLACES)))).alias("places"))
    )


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of base kinds, digest of the base spans, and all spans."""
    names = F.array(*map(F.lit, (*KINDS, FOUND_KIND)))
    count = lambda i: F.size(F.filter("base", lambda x: x["rank"] == i)).cast("long")
    return all_spans(docs, rounds).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("base"), names), 256).alias("base_sha256"),
        _joined(F.col("places"), names).alias("spans"),
        (F.size("places") - F.size("base")).cast("long").alias("n_found"),
    )


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (columns of ``documents``) with every span replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, under the kind of the first;
    ``n_chars`` is counted anew in changed rows.
    """
    docs = documents_like(docs)
    # Rows that repeat a document have the same places, so any of them serves.
    marks = all_spans(docs, rounds).filter(F.size("places") > 0).groupBy("key").agg(F.first("places").alias("places"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, FOUND_KIND)])
    keyed = docs.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    joined = keyed.join(stage_table(marks, "pii-marks"), "key", "left")

    def step(acc: Column, x: Column) -> Column:
        piece = F.substr("text", acc["at"] + 1, x["start"] - acc["at"])
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], piece, F.element_at(names, x["rank"] + 1))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))),
    )
    changed = joined.withColumn("clean", F.when(F.col("places").isNotNull(), clean).otherwise(F.col("text")))
    return changed.select(
        "doc_id",
        F.col("clean").alias("text"),
        "lang",
        "source",
        F.when(F.col("places").isNotNull(), F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )
