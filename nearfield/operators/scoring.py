"""Arrow-batched scorer: one matrix product per Arrow batch of the collection.

The query matrix is small by construction (its size is checked before it is
broadcast, see ``search._query_blocks``), the collection is streamed
partition by partition and never shuffled.  Each batch emits only the pairs
that pass the cut-off; with a ``cap`` a task keeps a running top-``cap`` per
query and emits at most ``queries x cap`` rows, whatever the two numbers are.

Per-row rules are the ones of ``nearfield.functions.vectors``: rows whose
vector is NULL, has the wrong length, a NULL or NaN element, or (for cosine)
a zero norm are skipped, i.e. they get a NULL score and are never a hit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Largest score block computed at once (rows x queries), in elements.
_BLOCK_ELEMS = 4_000_000
# Largest vector matrix converted at once (rows x dim), in elements (32 MB of
# float64): Arrow batches of wide vectors are scored in row slices.
_CHUNK_ELEMS = 4_000_000
# Largest per-task top-k state (queries x limit rows): a larger query set is
# searched in slices of at most this many result rows, or of one query.
PARTITION_TOPK_ROWS = 500_000
# Pairs found in a batch that are gathered before they join the top-k.
_FOUND_ROWS = 250_000


def _row_chunks(batches, chunk_rows: int):
    """Split Arrow batches into zero-copy slices of at most ``chunk_rows`` rows,
    so the float64 matrix of one step stays bounded for any dimension."""
    for b in batches:
        if b.num_rows <= chunk_rows:
            yield b
            continue
        for start in range(0, b.num_rows, chunk_rows):
            yield b.slice(start, chunk_rows)


def vector_matrix(col, d: int):
    """Arrow vector column -> (positions of rows with a length-``d`` vector,
    float64 matrix of those rows).

    Accepts ``list<float|double>`` and packed little-endian float32
    ``binary`` (``4 * d`` bytes per row).  NULL rows and rows of another
    length are left out; NULL elements become NaN (caught by the caller).
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        lens = pc.fill_null(pc.binary_length(col), -1).to_numpy()
        ok = lens == 4 * d
        rows = np.flatnonzero(ok)
        sub = col if len(rows) == len(col) else col.filter(pa.array(ok))
        if len(sub) == 0:
            return rows, np.zeros((0, d))
        odt = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        offs = np.frombuffer(sub.buffers()[1], dtype=odt)[sub.offset : sub.offset + len(sub) + 1]
        raw = np.frombuffer(sub.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
        return rows, raw.view("<f4").reshape(-1, d).astype(np.float64)
    lens = pc.fill_null(pc.list_value_length(col), -1).to_numpy()
    ok = lens == d
    rows = np.flatnonzero(ok)
    sub = col if len(rows) == len(col) else col.filter(pa.array(ok))
    M = np.asarray(sub.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return rows, M.reshape(len(rows), d)


@dataclass(frozen=True)
class Metric:
    """A metric from outside the library (H4).

    ``pairs(M, Q)`` gives the values of all rows of ``M`` (m x d) against all
    rows of ``Q`` (q x d), float64, as an m x q matrix; it runs in tasks, on
    blocks of bounded size.  ``column(v, q)`` is the same as a Column, for the
    SQL form of the search.
    """

    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]
    higher_is_better: bool
    column: Callable | None = None


BUILT_IN_METRICS = ("cosine", "ip", "l2")
_REGISTERED: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> None:
    """Make a metric known to ``ScoreRule`` and to requests by its lower-case name."""
    if name.lower() in BUILT_IN_METRICS:
        raise ValueError(f"{name!r} is a built-in metric")
    _REGISTERED[name.lower()] = metric


def registered_metric(name: str) -> Metric | None:
    return _REGISTERED.get(name)


def native_scores(raw: np.ndarray, transform: str) -> np.ndarray:
    if transform == "identity":
        return raw
    if transform == "half_shift":
        return (1.0 + raw) / 2.0
    if transform == "distance":
        return 1.0 - raw
    raise ValueError(f"unknown score transform {transform!r}")


def make_batch_scorer(
    bq,
    *,
    metric: str,
    transform: str,
    higher_is_better: bool,
    cutoff: float | None,
    cap: int | None,
    id_col: str,
    vec_col: str,
    carry: tuple[str, ...],
    out_schema,
    cell_col: str | None = None,
):
    """Build the function given to ``DataFrame.mapInArrow``.

    A registered metric is looked up here, on the driver, and travels with the
    function.

    ``bq`` is a broadcast of ``(query_ids int64[q], Q float64[q, d])`` or,
    for cell-probed (IVF, LSH) search, ``(query_ids, Q, probes)`` where
    ``probes`` maps a cell to the positions of the queries that probe it and
    ``cell_col`` names the cell of each collection row: the rows of a cell are
    multiplied with its own queries only.
    """

    outside = registered_metric(metric)
    pairs = outside.pairs if outside else None

    def pairs_of(M, sq, cells, probes, Q, Qs, q_sq):
        """(row, query, score) of the pairs of one batch that pass the cut-off, a bounded product at a time."""
        for at, cols in _probe_groups(cells, probes, len(M), len(Q)):
            step = max(1, _BLOCK_ELEMS // max(len(at), 1))
            Mg, sqg = (M, sq) if len(at) == len(M) else (M[at], sq[at])
            for c0 in range(0, len(cols), step):
                own = cols[c0 : c0 + step]
                G = Mg @ Qs[own].T if pairs is None else pairs(Mg, Qs[own])
                if metric == "l2":
                    raw = np.sqrt(np.maximum(sqg[:, None] + q_sq[None, own] - 2.0 * G, 0.0))
                else:
                    raw = G
                S = native_scores(raw, transform)
                mask = np.isfinite(S)
                if cutoff is not None:
                    mask &= (S >= cutoff) if higher_is_better else (S <= cutoff)
                if cap is not None and len(at) > cap:
                    # Keep the best `cap` per query column, plus exact ties.
                    key = np.where(mask, S if higher_is_better else -S, -np.inf)
                    kth = np.partition(key, len(at) - cap, axis=0)[len(at) - cap]
                    mask &= key >= kth[None, :]
                r, c = np.nonzero(mask)
                if len(r):
                    yield at[r], own[c], S[r, c]

    def score_partition(batches):
        import pyarrow as pa

        qids, Q, *rest = bq.value
        probes = rest[0] if rest else None
        q, d = Q.shape
        if metric == "cosine":
            Qs = Q / np.linalg.norm(Q, axis=1, keepdims=True)
        else:
            Qs = Q
        q_sq = np.einsum("ij,ij->i", Q, Q)
        names = ["query_id", id_col, "score", *carry]
        # With a cap, a running top-`cap` per query over the whole partition.
        pending, pending_rows = [], 0
        chunk_rows = max(1, _CHUNK_ELEMS // max(d, 1))
        for batch in _row_chunks(batches, chunk_rows):
            n = batch.num_rows
            if n == 0 or q == 0:
                continue
            vecs = batch.column(batch.schema.get_field_index(vec_col))
            rows, M = vector_matrix(vecs, d)
            if len(rows) == 0:
                continue
            sq = np.einsum("ij,ij->i", M, M)
            valid = np.isfinite(sq)
            if metric == "cosine":
                valid &= sq > 0
            if not valid.all():
                M, rows, sq = M[valid], rows[valid], sq[valid]
            cells = None
            if probes is not None:
                cells = batch.column(batch.schema.get_field_index(cell_col)).to_numpy(
                    zero_copy_only=False
                )[rows].astype(np.int64)
            m = len(rows)
            if m == 0:
                continue
            if metric == "cosine":
                M = M / np.sqrt(sq)[:, None]
            ids = batch.column(batch.schema.get_field_index(id_col))
            for r, c, s in _gathered(pairs_of(M, sq, cells, probes, Q, Qs, q_sq)):
                if metric == "l2":
                    # Re-score emitted pairs with the direct formula.
                    diff = M[r] - Q[c]
                    s = native_scores(np.sqrt(np.einsum("ij,ij->i", diff, diff)), transform)
                take = pa.array(rows[r])
                arrays = [pa.array(qids[c], type=pa.int64()), ids.take(take), pa.array(s, type=pa.float64())]
                for col in carry:
                    arrays.append(batch.column(batch.schema.get_field_index(col)).take(take))
                out = pa.RecordBatch.from_arrays(arrays, names=names).cast(out_schema)
                if cap is not None:
                    pending.append(out)
                    pending_rows += out.num_rows
                    if pending_rows > 2 * q * cap:
                        merged = _topk_per_query(pending, cap, higher_is_better, id_col)
                        pending, pending_rows = [merged], merged.num_rows
                else:
                    yield out
        if pending:
            yield _topk_per_query(pending, cap, higher_is_better, id_col)

    return score_partition


def _gathered(found):
    """The (row, query, score) arrays of ``found``, joined up to about _FOUND_ROWS pairs."""
    held, n_held = [], 0
    for part in found:
        held.append(part)
        n_held += len(part[0])
        if n_held >= _FOUND_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n_held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _probe_groups(cells, probes, m: int, q: int):
    """(rows, queries) to be multiplied: everything, or each cell with the queries that probe it."""
    if probes is None:
        yield np.arange(m), np.arange(q)
        return
    order = np.argsort(cells, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0])
    for rows in np.split(order, firsts[1:]):
        cols = probes.get(int(cells[rows[0]]))
        if cols is not None:
            yield rows, cols


def _topk_per_query(batches, cap: int, higher_is_better: bool, id_col: str):
    """Best ``cap`` rows per query over record batches, by (score, id)."""
    import pyarrow as pa

    t = pa.Table.from_batches(batches).combine_chunks()
    qid = t.column("query_id").to_numpy()
    sc = t.column("score").to_numpy()
    ids = t.column(id_col).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, -sc if higher_is_better else sc, qid))
    qs = qid[order]
    start = np.r_[0, np.flatnonzero(qs[1:] != qs[:-1]) + 1]
    rank = np.arange(len(qs)) - np.repeat(start, np.diff(np.r_[start, len(qs)]))
    keep = order[rank < cap]
    if len(keep) == 0:
        return pa.RecordBatch.from_pylist([], schema=t.schema)
    return t.take(pa.array(keep)).combine_chunks().to_batches()[0]


def make_mixed_scorer(bq, id_col: str, vec_col: str, carry: tuple[str, ...], out_schema):
    """Function for ``mapInArrow`` that scores requests of different rules with one product per batch.

    ``bq`` broadcasts the requests (vectors of one length).  The product of raw
    vectors serves all metrics; each group of requests with one rule turns
    it into its scores, and every request keeps its own limit of best rows.
    """

    def score_partition(batches):
        import pyarrow as pa

        requests = bq.value
        Q = np.array([r["embedding"] for r in requests], np.float64)
        q_sq = np.einsum("ij,ij->i", Q, Q)
        d = Q.shape[1]
        rules: dict[tuple, list[int]] = {}
        for i, r in enumerate(requests):
            rules.setdefault((r["metric"], r["transform"]), []).append(i)
        limits = np.array([r["max_hits"] if r["max_hits"] is not None else np.iinfo(np.int32).max for r in requests], np.int64)
        cutoffs = np.array([np.nan if r["cutoff"] is None else r["cutoff"] for r in requests])
        ids = np.array([r["query_id"] for r in requests], np.int64)
        stores = pa.array([r["store"] for r in requests], pa.string())
        mosts = pa.array([r["max_hits"] for r in requests], pa.int32())
        names = [f.name for f in out_schema]
        held, n_held = [], 0
        # Requests without a limit hand on all they find, as the batch that holds it goes by.
        bounded = limits < np.iinfo(np.int32).max
        room = 2 * int(limits[bounded].sum()) if bounded.any() else 0
        step = max(1, min(_CHUNK_ELEMS // max(d, 1), _BLOCK_ELEMS // len(requests)))
        for batch in _row_chunks(batches, step):
            rows, M = vector_matrix(batch.column(batch.schema.get_field_index(vec_col)), d)
            sq = np.einsum("ij,ij->i", M, M)
            ok = np.isfinite(sq)
            rows, M, sq = rows[ok], M[ok], sq[ok]
            if not len(rows):
                continue
            G = M @ Q.T
            found = []
            for (metric, transform), own in rules.items():
                own = np.array(own)
                raw = G[:, own]
                if metric == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        raw = raw / np.sqrt(sq[:, None] * q_sq[None, own])
                elif metric == "l2":
                    raw = np.sqrt(np.maximum(sq[:, None] + q_sq[None, own] - 2.0 * raw, 0.0))
                S = native_scores(raw, transform)
                key = S if metric != "l2" and transform != "distance" else -S
                sign = 1.0 if key is S else -1.0
                keep = np.isfinite(S) & ~(key < sign * cutoffs[own][None, :])
                r, c = np.nonzero(keep)
                score = S[r, c]
                if metric == "l2":  # emitted pairs are scored by the direct formula
                    diff = M[r] - Q[own[c]]
                    score = native_scores(np.sqrt(np.einsum("ij,ij->i", diff, diff)), transform)
                found.append((r, own[c], score, sign * score))
            r, c, score, key = (np.concatenate(x) for x in zip(*found))
            if not len(r):
                continue
            take, which = pa.array(rows[r]), pa.array(c)
            columns = [pa.array(ids[c]), stores.take(which), batch.column(batch.schema.get_field_index(id_col)).take(take), pa.array(score), pa.array(key), mosts.take(which)]
            columns += [batch.column(batch.schema.get_field_index(x)).take(take) for x in carry]
            out = pa.Table.from_arrays([*columns, pa.array(c)], names=[*names, "__request"])
            free = ~bounded[c]
            if free.any():
                yield from out.filter(pa.array(free)).select(names).cast(out_schema).to_batches()
            held.append(out.filter(pa.array(~free)))
            n_held += len(held[-1])
            if n_held > room:
                held = [_best_of_requests(held, limits, id_col)]
                n_held = len(held[0])
        if held:
            yield from _best_of_requests(held, limits, id_col).select(names).cast(out_schema).to_batches()

    return score_partition


def _best_of_requests(tables, limits: np.ndarray, id_col: str):
    """The best rows of each request, as many as its limit, by (key, id)."""
    import pyarrow as pa

    t = pa.concat_tables(tables).combine_chunks()
    request = t.column("__request").to_numpy()
    order = np.lexsort((t.column(id_col).to_numpy(zero_copy_only=False), -t.column("__key").to_numpy(), request))
    sorted_ = request[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return t.take(pa.array(order[rank < limits[sorted_]]))
