"""Property tests of the Arrow/numpy kernels against brute force (no Spark)."""

import string

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.functions.text import letter_counts
from nearfield.operators.scoring import _topk_per_query, native_scores, vector_matrix

finite = st.floats(min_value=-1e3, max_value=1e3, allow_nan=False, allow_infinity=False, width=32)


@settings(max_examples=60, deadline=None)
@given(
    rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.sampled_from([0.0, 0.5, 1.0, -0.25, 0.75])), min_size=1, max_size=60),
    cap=st.integers(1, 6),
    higher=st.booleans(),
)
def test_partition_topk_matches_sort(rows, cap, higher):
    # unique (query, id) pairs, as the scorer emits them
    seen = {}
    for q, i, s in rows:
        seen[(q, i)] = s
    qid = np.array([k[0] for k in seen], dtype=np.int64)
    ids = np.array([k[1] for k in seen], dtype=np.int64)
    sc = np.array(list(seen.values()), dtype=np.float64)
    batch = pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids), pa.array(sc)], names=["query_id", "id", "score"])
    got = _topk_per_query([batch], cap, higher, "id").to_pylist()
    want = []
    for q in sorted(set(qid.tolist())):
        items = [(s, i) for (qq, i), s in seen.items() if qq == q]
        items.sort(key=lambda t: ((-t[0] if higher else t[0]), t[1]))
        want += [(q, i, s) for s, i in items[:cap]]
    assert sorted((r["query_id"], r["id"], r["score"]) for r in got) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(
    vecs=st.lists(st.one_of(st.none(), st.lists(finite, min_size=0, max_size=5)), min_size=1, max_size=20),
    d=st.integers(1, 4),
)
def test_vector_matrix_list_and_packed_agree(vecs, d):
    arr = pa.array(vecs, type=pa.list_(pa.float32()))
    rows_l, M_l = vector_matrix(arr, d)
    packed = pa.array(
        [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in vecs], type=pa.binary()
    )
    rows_p, M_p = vector_matrix(packed, d)
    want = [i for i, v in enumerate(vecs) if v is not None and len(v) == d]
    assert rows_l.tolist() == want and rows_p.tolist() == want
    assert np.array_equal(M_l, M_p)
    for k, i in enumerate(want):
        assert np.array_equal(M_l[k], np.asarray(vecs[i], dtype=np.float32).astype(np.float64))


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet=string.ascii_letters + " \n.éß漢Ωé", max_size=40)), min_size=1, max_size=15))
def test_letter_counts_match_python(texts):
    got = letter_counts(pa.array(texts, type=pa.string())).to_pylist()
    for t, g in zip(texts, got):
        if t is None:
            assert g is None
        else:
            assert g == [float(t.count(c) + t.count(c.upper())) for c in string.ascii_lowercase]


@given(s=st.lists(st.floats(-1, 1), min_size=2, max_size=10))
def test_profile_transforms_are_monotone(s):
    a = np.sort(np.array(s))
    assert np.all(np.diff(native_scores(a, "half_shift")) >= 0)
    assert np.all(np.diff(native_scores(a, "distance")) <= 0)


def test_row_chunks_cover_batches():
    from nearfield.operators.scoring import _row_chunks

    b = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    parts = list(_row_chunks([b, b.slice(0, 3)], 4))
    assert [p.num_rows for p in parts] == [4, 4, 2, 3]
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(10)) + [0, 1, 2]
