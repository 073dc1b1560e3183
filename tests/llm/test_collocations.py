"""Collocations against a plain version over small fixtures, and against SQL over a whole table."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import collocations as CO
from nearfield.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, min_count, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p for p, a in f.items() if len(p[1]) > 1 and a >= min_count}

    def inside(p, q):
        return any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

    out = []
    for lang, p in cand:
        a = f[lang, p]
        if any(g == lang and len(q) > len(p) and inside(p, q) and f[g, q] >= a for g, q in cand):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


@given(st.lists(st.text(alphabet="aBé .,\t\n\x0b;x中", max_size=40) | st.none(), max_size=5))
@settings(max_examples=80, deadline=None)
def test_words_and_pieces(texts):
    w = CO.PieceWords(pa.array(texts, pa.string()), ["en"] * len(texts), 0)
    raw = w.data.tobytes()
    got, own = [], []
    for a, b, left in zip(w.starts, w.ends, w.left, strict=True):
        own.append(raw[a:b].decode())
        if left == 1:
            got.append(own)
            own = []
    assert got == [p for t in texts for p in pieces_of(t) if p]


def corpus():
    rng = np.random.default_rng(2)
    base = np.array(["New", "york", "city", "of", "the", "a", "b", "ñu", "x1", "(the"])
    rows = []
    for i in range(120):
        words = " ".join(rng.choice(base, int(rng.integers(0, 40))))
        rows.append((words + ". New York city hall, in the\tNew York " + "ha " * (i % 7), ["en", "de", None, ""][i % 4]))
    return [*rows, (None, "en"), ("", None), ("und text here. en und de text here en de", "und"), ("en de und", "en"), ("de de en und", "de"), rows[0], rows[0]]


def test_collocations_match_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(CO, "HELD_ENTRIES", 50)
    monkeypatch.setattr(CO, "HOT_SHARE", 12)  # the most frequent words go in slices
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "text string, lang string, rank int").repartition(3)
    for min_count, top in ((6, 2000), (15, 5)):
        got = sorted(tuple(r) for r in CO.collocations(docs, min_count, top=top).collect())
        assert got == plain(rows, min_count, top) and got


def test_scores_past_64_bits_stay_exact(spark):
    row = spark.createDataFrame([(4 * 10**15, 9 * 10**15, 4 * 10**15 + 1, 5 * 10**15)], "a long, n long, l long, r long")
    wide = "CAST({0} AS DECIMAL(38, 0))".format
    got = row.selectExpr(f"({wide(1000)} * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')}) AS s").first().s
    assert got == 1000 * 4 * 10**15 * 9 * 10**15 // ((4 * 10**15 + 1) * 5 * 10**15)


def test_one_hash_for_two_words_starts_again(spark, monkeypatch):
    whole = CO.word_hash

    def weak(data, starts, ends, langs, doc, seed):
        own = whole(data, starts, ends, langs, doc, seed)
        return (own & np.uint64(15)) | np.uint64(1) if seed == 0 else own

    monkeypatch.setattr(CO, "word_hash", weak)
    docs = spark.createDataFrame(corpus(), "text string, lang string")
    assert sorted(tuple(r) for r in CO.collocations(docs, 15).collect()) == plain(corpus(), 15)


def test_empty_table(spark):
    assert CO.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(CO.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in CO.collocations(table(spark, sf, "documents")).collect()) == want and want
