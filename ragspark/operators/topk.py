"""Best rows per question, inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole(array) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def best_rows(table: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each ``q`` by score descending, id ascending."""
    order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    table = table.take(order)
    q = table.column("q").to_numpy()
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], dtype=np.int64)
    nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return table.filter(pa.array(nth < k))


def best_cells(score: np.ndarray, ids: pa.Array, k: int, first_q: int = 0,
               matched: np.ndarray | None = None) -> pa.Table:
    """Best ``k`` of each row of a score matrix (questions x ids) as ``q, id, score``.

    Cells that are not ``matched`` are no hits; they must not score above those that are.
    """
    n = score.shape[1]
    keep = np.ones(score.shape, bool) if matched is None else matched
    if n > k:
        keep = keep & (score >= np.partition(score, n - k, axis=1)[:, n - k, None])
    q, v = np.nonzero(keep)
    return best_rows(pa.table({"q": pa.array(q + first_q, pa.int64()), "id": ids.take(pa.array(v)),
                               "score": score[q, v]}), k)
