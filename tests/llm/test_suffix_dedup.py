"""Suffix arrays and the removal of repeated strings against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import suffix_dedup as SD
from nearfield.llm.suffix_array import common_prefixes, suffix_array


@given(st.lists(st.lists(st.integers(0, 3), max_size=40).map(bytes) | st.binary(max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_suffix_order_and_common_prefixes(strings):
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    order, starts = suffix_array(data, lengths)
    assert sorted(order.tolist()) == list(range(len(data) + len(strings) + 1))
    ends = np.cumsum(lengths)
    number = np.repeat(np.arange(len(strings)), lengths)
    suffix = [data[i : ends[number[i]]].tobytes() for i in range(len(data))]
    index = {int(p): i for i, p in enumerate(np.arange(len(data)) + number)}
    listed = [index[p] for p in order.tolist() if p in index]
    assert [suffix[i] for i in listed] == sorted(suffix)
    previous, plcp = common_prefixes(data, lengths, order)
    for a, b in zip(listed, listed[1:], strict=False):
        same = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert (previous[b], plcp[b]) == (a, same)
    if listed:
        assert previous[listed[0]] == -1 and plcp[listed[0]] == 0


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    met = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if met[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus():
    rng = np.random.default_rng(5)
    words = np.array(["the", "of", "ñandú", "été", "running", "x", "中文", "over", "a", "zig"])
    draw = lambda n: " ".join(rng.choice(words, n))
    passage, hot = draw(30), draw(24)
    texts = [draw(int(n)) for n in rng.integers(0, 80, 30)]
    texts += [draw(9) + passage + draw(7), passage, draw(20) + " " + passage[10:120] + draw(3), passage[5:]]
    texts += [f"{draw(3)}{i}{hot}{i}{draw(4)}" for i in range(40)]
    texts += ["a" * 500, "ab" * 300, draw(40) * 2, None, "", texts[0], texts[3], texts[3], draw(3000)]
    return texts


@pytest.mark.parametrize("hot_regions", [SD.HOT_REGIONS, 3])
def test_repeats_match_the_plain_version(spark, hot_regions):
    texts, length = corpus(), 64
    rows = [(i, t, -1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(3)
    got = SD.suffix_dedup(docs, length, with_bytes=True, hot_regions=hot_regions).toPandas().set_index("doc_id")
    for i, (n_bytes, n_removed, n_spans, sha, kept) in enumerate(plain(texts, length)):
        row = got.loc[i]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256, bytes(row.kept_bytes)) == (n_bytes, n_removed, n_spans, sha, kept), i
        runs = [tuple(map(int, x.split(":"))) for x in row.removed_spans.split(",")] if row.removed_spans else []
        assert sum(b - a for a, b in runs) == n_removed


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    rows = [(1, text), (1, text), (None, text[:40]), (None, None), (2, ""), (3, text[3:] + "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in SD.suffix_dedup(docs, 50).collect())
    want = sorted((i or 0, n, gone) for (i, _), (n, gone, *_) in zip(rows, plain([t for _, t in rows], 50), strict=True))
    assert got == want
    assert SD.suffix_dedup(docs.limit(0), 50).count() == 0


def test_texts_are_cut_once_and_no_shuffle_stays(spark, monkeypatch):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read, join = [], SD._with_picks
    monkeypatch.setattr(SD, "_with_picks", lambda held, picks: read.append(held) or join(held, picks))

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    before = shuffles()
    found = SD.suffix_dedup(docs, 64, hot_regions=3)
    assert not shuffles() - before
    assert len(read) > 2 and sum(held is read[0] for held in read) == 1  # hot anchors are dealt anew from their regions
    assert found.count() == len(rows)


def test_copies_with_and_without_an_id_keep_their_own_marks(spark):
    rng = np.random.default_rng(9)
    a, b = ("".join(map(chr, rng.integers(97, 123, 200))) for _ in range(2))
    rows = [(None, a), (None, a), (7, a), (7, b), (7, b[:150]), (None, None), (None, a[:90] + b[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, *r[1:5]) for r in SD.suffix_dedup(docs, 40, hot_regions=1).collect())
    want = sorted((i or 0, *row[:4]) for (i, _), row in zip(rows, plain([t for _, t in rows], 40), strict=True))
    assert got == want


def test_regions_do_not_depend_on_the_chunk(monkeypatch):
    raw = np.random.default_rng(1).integers(97, 101, 4000).astype(np.uint8)
    bounds = np.array([0, 1500, 1500, 1530, 4000])
    for chunk in (SD._CHUNK, 700):
        monkeypatch.setattr(SD, "_CHUNK", chunk)
        text, first, count, anchor, _ = SD.find_regions(raw, bounds, 40)
        windows = {int(f) + k: int(a) for f, n, a in zip(first, count, anchor, strict=True) for k in range(n)}
        assert sorted(windows) == [i for i in range(4000) if any(a <= i and i + 40 <= b for a, b in zip(bounds, bounds[1:], strict=False))]
        assert all(s <= a <= s + 20 for s, a in windows.items())
        if chunk == SD._CHUNK:
            whole = windows
    assert windows == whole
