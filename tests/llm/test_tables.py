"""Archives, mixing, embeddings, near-duplicates, classifiers, personal data and the pipeline on small fixtures."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import components, cotraining, embedding_dedup, minhash_dedup, mixing, pii, toxicity, warc
from nearfield.llm.common import table
from nearfield.session import scratch_path

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- archives


def expected_records(pages):
    first = {}
    for page_id, _, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and page_id is not None:
            first[b] = min(first.get(b, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        b = (html or "").encode()
        to = first.get(b)
        again = to is not None and to != page_id
        out.append((page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return out


def test_archive_round_trip(spark):
    trap = "x" * 40 + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [
        (1, "http://a/", "<p>é</p>" * 40),
        (2, None, "<p>é</p>" * 40),
        (3, "http://b/\r\nX: y", None),
        (4, "u", ""),
        (5, "u", "short"),
        (6, "u", "short"),
        (7, "u", trap + "tail" * 50),
        (8, "u", trap),
        (9, "u", "WARC/1.1\r\n"),
        (10, "u", "\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n" * 30),
        (11, "u", "\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n" * 30),
        (None, "u", "n" * 200),
        (12, "u", "y" * 300 + "\n\r"),
        (12, "u", "y" * 300 + "\n\r"),
        (13, "u", "z" * 100_000 + "WARC/1.1\r\n" + "z" * 50_000),
    ]
    frame = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    path = scratch_path(spark, "test-warc")
    warc.write_warc(frame, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("1000", "40000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = [tuple(r)[:5] for r in warc.page_digests(spark, path).collect()]
            whole = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        key = lambda r: (str(r[0]), r[2])
        assert sorted(got, key=key) == sorted(expected_records(pages), key=key)
        for page_id, _, html in pages:
            r = whole[f"<urn:page:{'null' if page_id is None else page_id}>"]
            if r["record_type"] == "response":
                assert bytes(r["payload"]).decode() == (html or "")
        assert "<urn:page:77>" not in whole


def test_archive_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc-empty")
    warc.write_warc(empty, path)
    assert warc.page_digests(spark, path).count() == 0


def test_chain_skips_what_is_not_reached():
    offsets, successors = np.array([0, 10, 25, 30, 55]), np.array([25, 99, 55, 40, 80])
    assert warc.reachable(offsets, successors).tolist() == [True, False, True, False, True]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]


# ---- mixing


def plain_targets(sizes, weights):
    capped, targets = set(), {}
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i] for i in free)
        targets = {i: 3.0 * sizes[i] if i in capped else left * weights[i] / w for i in range(len(sizes))}
        over = {i for i in free if targets[i] > 3 * sizes[i]}
        if not over:
            return [targets[i] for i in range(len(sizes))]
        capped |= over


def test_targets_against_resharing():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        sizes = [int(x) for x in rng.integers(0, 50, n) ** 3]
        weights = [float(1 + i % 3) for i in range(n)]
        assert np.allclose(mixing.water_fill(sizes, weights), plain_targets(sizes, weights))


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 7).tolist() != mixing.permute(np.arange(1000), 1000, 8).tolist()


def test_tasks_grow_with_the_shards():
    assert [mixing._tasks(n) for n in (0, 1, 200, 201, 12_800, 12_801, 10**7)] == [1, 1, 200, 200, 200, 201, 156_250]


def test_mix_counts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        source = ["a", "b", "ö", None, "Z"][int(rng.choice(5, p=[0.7, 0.1, 0.1, 0.05, 0.05]))]
        rows.append((i, " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 400)))), source, "t"))
    rows += [(500, None, "a", "t"), (501, "", "b", "t"), (7, rows[7][1], rows[7][2], "t"), (None, "x y z", "only", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(3)
    got = mixing.mix_counts(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(
        (False, d, len(WORD.findall(t or ""))) for d, t, _, _ in rows if d is not None
    )
    source = {(d, len(WORD.findall(t or ""))): s for d, t, s, _ in rows}
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for _, t, s, _ in rows if s == n) for n in names]
    targets = dict(zip(names, plain_targets(sizes, [1.0 + i % 3 for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[names.index(s)] and abs(r["target"] - targets[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, want in targets.items():
        assert abs(taken[s] - want) <= 3 * mixing.BLOCK
    again = mixing.mix_counts(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_counts(docs.limit(0)).count() == 0
    mixed = mixing.mix_documents(docs).collect()
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(words)


# ---- components and embeddings


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == plain_components({x for p in real for x in p}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, vec_id = [], 0
    for label in (0, 1, 2):
        for _ in range(40):
            base = rng.normal(size=24)
            for _ in range(int(rng.choice([1, 1, 1, 2, 3, 30], p=[0.3, 0.2, 0.2, 0.15, 0.13, 0.02]))):
                rows.append((vec_id, [float(np.float32(x)) for x in base + rng.normal(size=24) * 0.12], label))
                vec_id += 1
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (0, rows[0][1], 0)]
    rows += [(1002, None, 1), (1003, [0.0] * 24, 1), (1004, [float("nan")] * 24, 1), (1005, [None, 1.0], 1), (1006, rows[0][1], None), (1007, [1.0, 0.0], 0)]
    rows += [(1008, [2.0, 0.0], 0), (1009, [], 0)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    good = [
        i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
    ]
    links = []
    for x, i in enumerate(good):
        for j in good[x + 1 :]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links.append((i, j))
    member = plain_components(range(len(rows)), links)
    lowest = {}
    for i, m in member.items():
        lowest[m] = min(lowest.get(m, rows[i][0]), rows[i][0])
    degree = Counter(x for p in links for x in p)
    want = sorted((r[0], degree[i], lowest[member[i]], r[0] == lowest[member[i]]) for i, r in enumerate(rows))
    assert sorted(map(tuple, embedding_dedup.embedding_links(frame).collect())) == want
    assert embedding_dedup.embedding_links(frame.limit(0)).count() == 0


def test_embedding_links_between_dense_groups(spark):
    """Two groups that fill every bounded list by themselves, linked to each other."""
    rng = np.random.default_rng(6)
    centre = np.zeros((2, 48))
    centre[:, 0], centre[1, 1] = 1.0, np.tan(np.arccos(0.945))
    parts = [c / np.linalg.norm(c) + rng.normal(size=(150, 48)) * 0.011 for c in centre]
    vectors = np.concatenate(parts)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    assert near[:150, 150:].any() and near[:150, :150].sum(1).min() > embedding_dedup.MAX_NEIGHBOURS
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_dedup.embedding_links(frame).collect()))
    assert got == [(i, int(n), 0, i == 0) for i, n in enumerate(near.sum(1))]


def test_embedding_links_that_the_descent_never_meets(spark, monkeypatch):
    """A descent that starts from no pair at all costs no link."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * 0.01], i % 12 % 2) for i in range(30)]
    monkeypatch.setattr(embedding_dedup, "leaf_pairs", lambda *a: spark.createDataFrame([], "src long, dst long, sim double"))
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (2 if i % 12 < 6 else 1, i % 12) for i in range(30)}


def test_cross_links_over_several_blocks(spark, monkeypatch):
    """Blocks that meet, blocks ruled out by their radii, and labels of one block give the components of all pairs."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(9, 16))
    rows = [(i, int(i % 4 == 0), base[i % 9] * 3 + rng.normal(size=16) * (0.2 + 0.6 * (i % 5 == 0))) for i in range(400)]
    rows += [(400, 0, -rows[1][2]), (401, 0, np.ones(3))]
    nodes = spark.createDataFrame([(i, label, (v + 0.0).tobytes()) for i, label, v in rows], "node long, label int, vector binary")
    links = []
    for x, (i, label, v) in enumerate(rows):
        for j, other, w in rows[x + 1 :]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
    monkeypatch.setattr(embedding_dedup, "MERGE_BLOCK", 16)
    none = spark.createDataFrame([], "id long, component long")
    got = {r["id"]: r["component"] for r in embedding_dedup.merge_components(nodes, none, 0.93).collect()}
    assert got == plain_components([r[0] for r in rows], links)


# ---- near-duplicates


def bag(text):
    w = WORD.findall(text.lower())
    runs = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return {r: 1 + np.log2(n) for r, n in runs.items()}


def plain_similarity(a, b):
    runs = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in runs) for i in a if i in b)


def links_with(a, b):
    return max(plain_similarity(a, b), len(a.keys() & b.keys()) / len(a.keys() | b.keys())) >= 0.8


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(6)
    for _ in range(15):
        w = [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(6, 300)))]
        w += w[: len(w) // 3]
        v = [x if rng.random() > 0.02 else "new" for x in w]
        pair = [" ".join(w), " ".join(v)]
        doc, code, weight, _ = minhash_dedup.weighted_shingles(pa.array(pair))
        exact = plain_similarity(bag(pair[0]), bag(pair[1]))
        sides = [(code[doc == i], weight[doc == i]) for i in (0, 1)]
        assert abs(minhash_dedup.probability_jaccard(*sides[0], *sides[1]) - exact) < 1e-9
        registers = minhash_dedup.prob_min_hash(doc, code, weight, 2, 3000)
        assert abs((registers[0] == registers[1]).mean() - exact) < 0.05


def test_classes_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, 250)))]
        if len(base) > 100 and rng.random() < 0.3:
            base = base[:40] * 8 + base[40:]
        for _ in range(int(rng.choice([1, 2, 3, 12]))):
            rate = float(rng.choice([0.0, 0.004, 0.01, 0.03]))
            texts.append(" ".join(x if rng.random() > rate else "e%d" % rng.integers(1e6) for x in base))
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), "", None, "  \n", "one two", "One Two", "one three"]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(3, texts[3], -1), (None, texts[5], -1), (4, "another text under an old id", -1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class_id int").repartition(4)
    bags = [bag(t or "") for _, t, _ in rows]
    links, unsure = [], 0
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and links_with(bags[i], bags[j]):
                links.append((i, j))
    member = plain_components(range(len(rows)), links)
    lowest = {}
    for i, m in member.items():
        if rows[i][0] is not None:
            lowest[m] = min(lowest.get(m, rows[i][0]), rows[i][0])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(((r[0], lowest[member[i]]) for i, r in enumerate(rows)), key=key)
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash_dedup.near_duplicate_classes(frame).collect()), key=key)
    unsure = sum(a != b for a, b in zip(got, want, strict=True))
    assert unsure == 0
    stay = sorted(((r["doc_id"], r["text"]) for r in minhash_dedup.drop_near_duplicates(frame).collect()), key=str)
    one_each, seen = [], set()
    for i, (d, t, _) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        if d is None or not bags[i]:
            one_each.append((d, t))
        elif member[i] not in seen:
            seen.add(member[i])
            one_each.append((d, t))
    assert sorted((d for d, _ in stay), key=str) == sorted((d for d, _ in one_each), key=str)
    assert minhash_dedup.near_duplicate_classes(frame.limit(0)).count() == 0
    assert minhash_dedup.drop_near_duplicates(frame.limit(0)).count() == 0


# ---- classifiers


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    test = got[got.held_out & got.toxic.notna()]
    # 29 toxic texts of 11 vocabularies are all there is to learn from at this size.
    assert (test.predicted[test.toxic == 0] == 0).mean() >= 0.97
    assert test.score[test.toxic == 1].mean() > test.score[test.toxic == 0].mean() + 0.3


def test_toxicity_learns_unseen_spellings():
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "st", "ra", "kel")]
    texts, toxic = [], []
    for i in range(600):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[int(rng.integers(0, 30))] = "zwurtag" + str(rng.choice(["", "s", "ed", "ing", "ly", "ness"]))
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    model = toxicity.train(texts, toxic)
    new = ["ban dera zwurtagged mon", "zwurtagful", "ban dera mon lura", "", None]
    score = toxicity.score_texts(model, pa.array(new))
    assert (score[:2] >= 0.7).all() and (score[2:] < 0.3).all()
    assert not toxicity.train([], []).logits.any() and not toxicity.train(["a"], [1]).logits.any()


def test_toxicity_trains_on_long_texts(spark):
    """All toxic labels stand at texts that are far longer than the others."""
    rows = [(i, "calm  Day " * 2_000 + "foulmouth, calm" if i % 2 else f"calm day {i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    sample = toxicity.training_rows(docs, labels).toPandas()
    assert sorted(set(sample.text[sample.toxic == 1])) == ["calm day foulmouth"]
    got = toxicity.toxicity(docs, labels).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {r[0]: r[2] for r in rows}


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "abc", 0.5), (3, "word " * 5000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, none).count() == 4
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_quality_on_rows_not_fitted(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    known = labels.filter("doc_id % 2 = 0")
    got = cotraining.quality(docs, known).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got.accepted[got.quality == 1].mean() >= 0.98
    assert got.accepted[got.quality == 0].mean() <= 0.2
    kept = cotraining.accept_documents(docs, known)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == cotraining.quality(docs, known).filter("accepted").count()


def test_quality_edges(spark):
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, 1.0), (None, "some text", "en", None, 9, 1.0), (2, "", "en", "s", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    both = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one_kind):
        assert cotraining.quality(docs, labels).filter("accepted").count() == 4
    assert cotraining.quality(docs, both).count() == 4
    assert cotraining.quality(docs.limit(0), both).count() == 0


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_against_plain_patterns(spark):
    rng = np.random.default_rng(9)
    parts = ["a@b.c", "d.e+f@x-y.org", "_", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0255.01.1.1", "4111111111111111", "4111 1111-1111 1111", " ", "  "]
    parts += ["é", "中", "+1 (555) 123-4567", "+1", "-", "12", "3", "+", "(", ")", "x", "\n", "mail", "12345678901234567890"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(600)]
    texts += [None, "", "9" * 5000, "a" * 20000, "a@" * 3000, "1 " * 4000, "+1" + "." * 5000, "a@b" + ".c" * 3000, "1.1" * 2000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "a@b.c", "s")], "doc_id long, text string, spans string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got}
    for i, text in enumerate(texts):
        want = plain_base(text or "")
        r = by[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(x.startswith(kind + ":") for x in want)
        assert [x for x in r["spans"].split(",") if x and not x.startswith("id:")] == want
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    mails = [(i, f"note {i} please write to user{i}@example.org today or later") for i in range(30)]
    hidden = [(100 + i, f"or else write to acct-77{i}x{i}99 today as well") for i in range(5)]
    clean = [(200, "chapter12345 of the volume2020 has no private words"), (201, "plain words only")]
    docs = spark.createDataFrame(mails + hidden + clean, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    for doc_id, text in hidden:
        (span,) = got[doc_id]["spans"].split(",")
        kind, a, b = span.split(":")
        assert kind == "id" and text[int(a) : int(b)].startswith("acct-77")
    assert got[200]["spans"] == "" and got[201]["n_found"] == 0
    clean_text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean_text[3] == "note 3 please write to <EMAIL> today or later"
    assert clean_text[102] == "or else write to <ID> today as well" and clean_text[201] == "plain words only"


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage_table(stage(spark, docs, SMALL), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] <= 200 and counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] > 0
    empty = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


@pytest.mark.parametrize("name", ["op3_warc", "op6_packing", "op7_line_rules"])
def test_registered_queries_carry_their_columns(spark, name):
    from nearfield.llm.queries import QUERIES

    want = {
        "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op7_line_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }[name]
    assert set(want) <= set(QUERIES[name](spark, SMALL).columns)


def test_blocks_find_the_same_links():
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 300, 60)]
    texts = []
    for i in range(60):
        w = [x if rng.random() > 0.02 else f"n{rng.integers(50)}" for x in (base * 4 if i % 4 == 0 else base)]
        texts.append(" ".join(w))
    texts += ["", "one two", "one two"]
    found = set(zip(*(x.tolist() for x in minhash_dedup._links_between(pa.array(texts), pa.array(texts), 0.8)), strict=True))
    bags = [bag(t) for t in texts]
    assert found == {(i, j) for i, a in enumerate(bags) for j, b in enumerate(bags) if a and b and links_with(a, b)}


def test_blocks_compute_only_pairs_that_can_link(monkeypatch):
    # 25 words in common and 5 of one's own: 21 of 31 runs, so 0.68, though 21 of 26 runs of either text are common.
    texts = [" ".join([*(f"c{i}" for i in range(25)), *(f"own{k}x{i}" for i in range(5))]) for k in range(30)]
    calls = []
    exact = minhash_dedup.probability_jaccard
    monkeypatch.setattr(minhash_dedup, "probability_jaccard", lambda *a: calls.append(1) or exact(*a))
    a, b = minhash_dedup._links_between(pa.array(texts), pa.array(texts), 0.8)
    assert a.tolist() == b.tolist() == list(range(30)) and not calls


def test_components_remove_the_tables_of_their_steps(spark, monkeypatch):
    written = []
    path = components.scratch_path
    monkeypatch.setattr(components, "scratch_path", lambda *a: written.append(path(*a)) or written[-1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert len(written) > 2 and sum(os.path.exists(p) for p in written) == 1
