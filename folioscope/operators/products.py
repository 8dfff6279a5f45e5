"""Products of sparse rows with sparse queries, the best of them for each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope import shared

#: Entries of vectors that are multiplied at once. A bound on memory only.
STEP_ENTRIES = 1 << 17
#: Of the queries' dimensions, the most frequent ones are multiplied as matrices, and only for rows whose bound asks for it.
COMMON = 2048


def entries(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dim, w) of the batch's vectors, one entry after the other."""
    lists = [batch.column(c) for c in ("dims", "ws")]
    dims, ws = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in lists)
    n = np.asarray(pc.fill_null(pc.list_value_length(dims), 0), dtype=np.int64)
    return np.repeat(np.arange(len(n)), n), np.asarray(dims.flatten(), dtype=np.int64), np.asarray(ws.flatten(), dtype=np.float64)


def multiplied(queries: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(qid, rid, score) of the k best of these rows for each query.

    The queries' most frequent dimensions are common, the others rare. Rare ones are added up entry by entry. What the common
    ones can add is bounded by the product of both sides' norms over them; rows whose bound reaches no query's k-th score so
    far are done, and the others' common entries are multiplied as matrices.
    """
    qids = np.asarray(queries.column("qid"), dtype=np.int64)
    q, qdim, qw = entries(queries)
    dims, counts = np.unique(qdim, return_counts=True)
    common = np.sort(dims[np.argsort(-counts, kind="stable")[:COMMON]])
    size = int(dims[-1]) + 1 if len(dims) else 0
    place = np.full(size, -1, np.int32)
    place[common] = np.arange(len(common))
    shared_part = place[qdim] >= 0
    matrix = np.zeros((len(common), len(qids)))
    matrix[place[qdim[shared_part]], q[shared_part]] = qw[shared_part]
    most = np.sqrt((matrix**2).sum(axis=0))
    rare = ~shared_part
    order = np.argsort(qdim[rare], kind="stable")
    rq, rw = q[rare][order], qw[rare][order]
    starts = np.searchsorted(qdim[rare][order], np.arange(size + 1)).astype(np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in qids]
    least = np.full(len(qids), -1.0)
    for batch in batches:
        rids = np.asarray(batch.column("rid"), dtype=np.int64)
        row, dim, w = entries(batch)
        asked = dim < size
        row, dim, w = row[asked], dim[asked], w[asked]
        bounds = np.searchsorted(row, np.arange(len(rids) + 1))
        cells = max(1, STEP_ENTRIES * 4 // max(len(common) + len(qids), 1))
        at = 0
        while at < len(rids):
            to = max(at + 1, min(at + cells, int(np.searchsorted(bounds, bounds[at] + STEP_ENTRIES, side="right")) - 1))
            r, d, x, rid, n = row[bounds[at] : bounds[to]] - at, dim[bounds[at] : bounds[to]], w[bounds[at] : bounds[to]], rids[at:to], to - at
            at = to
            meets = starts[d + 1] - starts[d]
            entry = np.repeat(np.arange(len(d)), meets)
            other = np.arange(len(entry)) - np.repeat(np.cumsum(meets) - meets, meets) + np.repeat(starts[d], meets)
            scores = np.bincount(r[entry] * len(qids) + rq[other], weights=x[entry] * rw[other], minlength=n * len(qids)).astype(np.float64).reshape(n, len(qids))
            in_common = place[d] >= 0
            norms = np.sqrt(np.bincount(r[in_common], weights=x[in_common] ** 2, minlength=n))
            reach = ((scores + np.outer(norms, most) + 1e-8) >= least).any(axis=1) & (norms > 0)
            if reach.any():
                kept = in_common & reach[r]
                number = np.cumsum(reach) - 1
                dense = np.zeros((int(reach.sum()), len(common)))
                dense[number[r[kept]], place[d[kept]]] = x[kept]
                scores[reach] += dense @ matrix
            for i in np.flatnonzero((scores > 0).any(axis=0) & (scores.max(axis=0) + 1e-8 >= least)).tolist():
                s = scores[:, i]
                some = np.flatnonzero((s > 0) & (s + 1e-8 >= least[i]))
                ids, found = np.concatenate([best[i][0], rid[some]]), np.concatenate([best[i][1], s[some]])
                first = np.lexsort((ids, -np.round(found, 9)))[:k]
                best[i] = ids[first], found[first]
                if len(first) == k:
                    least[i] = found[first].min()
        shared.let_go()
    n = [len(ids) for ids, _ in best]
    if sum(n):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate([ids for ids, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["qid", "rid", "score"])
