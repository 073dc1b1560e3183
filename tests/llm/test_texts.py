"""Line rules, packing, sentence spans and word hashing against plain versions."""

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import line_rules, packing, span_dedup, texthash
from nearfield.llm.common import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.text(alphabet=st.sampled_from(list("abcAé .,!?\n\t\x0b|#*ß中\x1c’")), max_size=80)


@given(st.lists(TEXTS | st.none(), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_match_the_pattern(texts):
    words = texthash.split_words(pa.array(texts, pa.string()))
    raw = bytes(words.data)
    got = [(int(d), raw[a:b].decode()) for d, a, b in zip(words.doc, words.starts, words.ends, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert len({h for h in words.hash.tolist()}) == len({w for _, w in got})


def plain_counts(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(TEXTS | st.lists(st.sampled_from(["a", "b", "c", "\n"]), max_size=60).map(" ".join))
@settings(max_examples=200, deadline=None)
def test_line_counts(text):
    assert line_rules.text_counts(text) == plain_counts(text)


def test_line_rules_edges(spark):
    prose = "\n".join(f"Plain{i} words{i} make{i} a clean{i} line{i}." for i in range(12))
    nav = "\n".join("Home | News | Sport | Contact | About" for _ in range(12))
    rows = [(1, prose, 9), (2, nav, 9), (3, None, 9), (4, "", 9), (5, prose, 9), (5, prose, 9), (None, prose + "\n" + nav, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r["doc_id"]: r for r in line_rules.line_rules(docs).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[3]["base_failed"] and got[4]["n_words"] == 0
    assert got[None]["n_removed_lines"] == 12
    assert line_rules.line_rules(docs).count() == 7
    assert line_rules.line_rules(docs.limit(0)).count() == 0
    cleaned = line_rules.line_rules(docs, with_text=True).filter("doc_id is null").first()["clean_text"]
    assert cleaned == prose


@functools.cache
def _tokens():
    return packing.WordTokens(tokenizer_path())


@pytest.fixture(scope="module")
def tokens():
    return _tokens()


@given(st.lists(st.text(max_size=40) | TEXTS, max_size=5))
@settings(max_examples=150, deadline=None)
def test_cached_words_give_the_tokenizers_ids(texts):
    own = _tokens()
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, ends)[:-1]] if texts else []
    assert got == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_spellings_of_a_run_are_looked_up_once():
    own = packing.WordTokens(tokenizer_path())
    texts = ["Sample sample, SAMPLE. sample!? sample", "", None, "-- can't, sample", "Été été"]
    ids, ends = own.encode(pa.array(texts))
    assert set(own.index) == {"", "sample", ",", ".", "!?", "--", "can't,", "été"}
    got = [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark, tokens):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 50, n)) for n in (*rng.integers(0, 300, 60), 6000)]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(99, None, -1), (100, "", -1), (7, texts[7], -1), (None, "x <|endoftext|> y", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    got = packing.pack_documents(docs, tokenizer_path()).toPandas()
    assert (got.length > 0).all()
    by_sequence = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    padding = 0
    for _, s in by_sequence:
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        n = int(s.length.sum())
        assert n <= 4096 and (s.sequence_length == n).all()
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding < 0.03 * got.length.sum()
    for doc, text, _ in rows:
        ids = np.array([*tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values("start")
        copies = 2 if doc == 7 else 1
        assert own.length.sum() == copies * len(ids) and (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[int(p.start) : int(p.start + p.length)].tobytes()) == p.ids_crc32
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def plain_spans(docs, min_sentences, min_words):
    """Sentences and removals as the definition says, with Python loops and tuples of words."""
    cut = {}
    for doc_id, text in docs:
        words, sent = span_dedup.split_sentences(pa.array([text]))
        raw = bytes(words.data)
        w = [raw[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
        cut[doc_id, text] = [tuple(w[a:b]) for a, b in zip(sent.first, sent.end, strict=True)]
    seen, removed = set(), {}
    for key in sorted(cut, key=lambda k: k[0]):
        s = cut[key]
        removed[key] = set()
        for i in range(len(s)):
            j = i
            while j < len(s) and (j - i < min_sentences or sum(map(len, s[i:j])) < min_words):
                j += 1
            if j - i < min_sentences or sum(map(len, s[i:j])) < min_words:
                continue
            span = sum(s[i:j], ())
            if span in seen:
                removed[key] |= set(range(i, j))
            seen.add(span)
    return {k: (len(cut[k]), len(v), sum(len(cut[k][i]) for i in v)) for k, v in removed.items()}


def plain_sentences(text, window):
    """Words per sentence with Python loops; the hash of a word is that of the word alone."""
    alone = {}

    def word_hash(word):
        if word not in alone:
            alone[word] = int(texthash.split_words(pa.array([word])).hash[0])
        return alone[word]

    spans = [m.span() for m in WORD.finditer(text)]
    w = [text[a:b] for a, b in spans]
    ends = {len(w)}
    for i in range(len(w) - window + 1):
        ends.add(1 + max(range(i, i + window), key=lambda k: (-word_hash(w[k]), k)))
    for i in range(len(w) - 1):
        if w[i][-1] in ".!?;:," or "\n" in text[spans[i][1] : spans[i + 1][0]]:
            ends.add(i + 1)
    ends = sorted(ends - {0})
    return [tuple(w[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def test_sentences_against_loops():
    rng = np.random.default_rng(4)
    texts = ["", "one", "a " * 30, "x " * 7, "naïve Wörter, über alles\n\nund weiter; fort. Ende"]
    texts += [" ".join(f"w{x}" + ("." if x % 9 == 0 else "") + ("\n" if x % 17 == 0 else "") for x in rng.integers(0, 90, n)) for n in range(0, 120, 7)]
    words, sent = span_dedup.split_sentences(pa.array([*texts, None]))
    raw = bytes(words.data)
    w = [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]
    for i, text in enumerate([*texts, ""]):
        got = [tuple(w[a:b]) for d, a, b in zip(sent.doc, sent.first, sent.end, strict=True) if d == i]
        assert got == plain_sentences(text, span_dedup.WINDOW), i


def test_passage_without_marks_in_mid_sentence(spark):
    """Every copied run of 51 words without a mark or a line break loses words in all places but its first."""
    rng = np.random.default_rng(5)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 5_000, k)]
    docs, passages = [], 300
    for i in range(passages):
        passage = word(51)
        for copy in range(2):
            docs.append((2 * i + copy, " ".join(word(int(rng.integers(0, 40))) + passage + word(int(rng.integers(0, 40))))))
    got = span_dedup.span_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {2 * i + 1 for i in range(passages)}
    cut = np.array([r["removed_words"] for r in got if r["n_removed"]])
    assert cut.min() >= span_dedup.MIN_WORDS and cut.max() <= 51 and cut.mean() > 35


def test_spans_against_loops(spark):
    rng = np.random.default_rng(3)
    sentence = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 14))) + "."
    passages = [" ".join(sentence() for _ in range(12)) for _ in range(3)]
    docs = []
    for i in range(40):
        own = [sentence() for _ in range(rng.integers(0, 12))]
        if i % 3 == 0:
            own.insert(len(own) // 2, "glued " + passages[i % 3] + " " + passages[(i // 3) % 3])
        if i % 10 == 1:
            own += own
        docs.append((i, (" " if i % 2 else "\n").join(own)))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, runs string").repartition(4)
    got = {r["doc_id"]: r for r in span_dedup.span_dedup(frame).collect()}
    for (doc_id, text), facts in plain_spans(docs, span_dedup.MIN_SENTENCES, span_dedup.MIN_WORDS).items():
        r = got[doc_id]
        assert (r["n_sentences"], r["n_removed"], r["removed_words"]) == facts
        gone = [tuple(map(int, x.split(":"))) for x in r["removed_spans"].split(",") if x]
        left = text
        for a, b in reversed(gone):
            left = left[:a] + left[b:]
        assert WORD.findall(left) == WORD.findall(r["clean_text"])
    long = [p for p in passages if sum(p in t for _, t in docs) > 1]
    assert long
    for p in long:
        holders = sorted(i for i, t in docs if p in t)
        for i in holders[1:]:
            assert p not in got[i]["clean_text"]


def test_spans_edges(spark):
    passage = " ".join(f"One two three number {i}, and more of it." for i in range(9))
    rows = [(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (4, "Short."), (5, "Clean text, " + passage.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = span_dedup.span_dedup(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and not by[1]["changed"] and by[2]["clean_text"] is None and by[3]["clean_text"] == ""
    assert by[None]["changed"] and not by[4]["changed"] and not by[5]["changed"]
    assert span_dedup.span_dedup(docs.limit(0)).count() == 0
