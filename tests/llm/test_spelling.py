"""Spelling variants against a plain version: every pair of words, edit by edit."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return n


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_groups(rows):
    n = {w: c for w, c in plain_words(rows).items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * c else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


@given(st.lists(st.text(alphabet="aAbZzÉÿ×÷ 1-中ſ", max_size=30) | st.none(), max_size=5), st.integers(0, 10**12))
@settings(max_examples=100, deadline=None)
def test_words_and_slips(texts, first_id):
    texts = [t and t * 3 for t in texts]
    ids = [first_id + i if i else None for i in range(len(texts))]
    words, counts = spelling.words_of(pa.array(texts, pa.string()), ids)
    got = Counter()
    for w, c in zip(words, counts.tolist(), strict=True):
        got[w] += c
    assert got == {w: c for w, c in plain_words(zip(ids, texts, strict=True)).items() if len(w) >= 5}


def test_checksums_of_long_runs():
    raw = b"abc" * 200 + b"de"
    data = np.frombuffer(raw, np.uint8)
    starts, ends = np.array([0, 5, 7, 600]), np.array([600, 53, 56, 602])
    prefix = [zlib.crc32(b"12:"), zlib.crc32(b"x"), 0, zlib.crc32(b"9:")]
    got = spelling.run_checksums(data, starts, ends, np.array(prefix, np.uint32))
    assert got.tolist() == [zlib.crc32(raw[a:b], p) for a, b, p in zip(starts, ends, prefix, strict=True)]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    stems = ["colour", "banana", "aaaaa", "aaaaaa", "straße", "ÉTUDE", "mississippi", "rhythm", "abcab", "bcabc", "prefixprefixes"]
    rows = []
    for i in range(n):
        words = []
        for w in rng.choice(stems, 12):
            w = str(w)
            for _ in range(int(rng.integers(0, 3))):
                at, c = int(rng.integers(0, len(w) + 1)), str(rng.choice(list("abé")))
                w = [w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]][int(rng.integers(0, 3))]
            words.append(w)
        rows.append((i, " ".join(words)))
    chain = [(n + 10 + i, "abcdefgh" + " abcdefg" * (i % 3 == 0) + " abcdef" * (i % 9 == 0)) for i in range(40)]
    return rows + chain + [(None, "colour colour Colour"), (n, None), (n + 1, ""), rows[0], rows[0], (n + 2, "x" * 300 + " " + "x" * 301), (n + 3, ("x" * 300 + " " + "x" * 301 + " ") * 3)]


@pytest.mark.parametrize("group", [spelling.GROUP, 4])
def test_groups_match_the_plain_version(spark, group):
    rows = corpus(3, 160)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_groups(docs, group).collect()}
    assert got == plain_groups(rows)
    assert sum(v[1] for v in got.values()) > 100 and any(v[4] != (v[2] or k) for k, v in got.items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = spelling.spelling_groups(docs)
    assert got.count() == 0 and set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
