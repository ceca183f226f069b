"""Local top-k kernels that run inside Spark tasks, on one block of units and one block of questions at a time.

Spark decides the blocks and merges their results; a kernel only ever returns ``k`` hits per question, so the pairs of
a block are never materialised as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 4_000_000  # score cells held at once

K1, B = 1.2, 0.75
DIGITS = 9  # scores are compared after rounding, ties go to the smaller unit id


def list_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def normalised(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best cells per row; ties go to the lower column, ``-inf`` never counts."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        rows, cols = np.nonzero((scores >= floor) & (scores > -np.inf))
    else:
        rows, cols = np.nonzero(scores > -np.inf)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _by_key(keys: pa.ChunkedArray) -> dict[str, np.ndarray]:
    encoded = keys.combine_chunks().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    return {key: order[edges[i]:edges[i + 1]] for i, key in enumerate(encoded.dictionary.to_pylist())}


def cosine_kernel(questions: pa.Table, units: pa.Table) -> Callable:
    q, u = normalised(list_matrix(questions["embedding"])), normalised(list_matrix(units["embedding"]))

    def blocks(qi: np.ndarray, ui: np.ndarray):
        step = max(1, CELLS // max(1, len(ui)))
        for start in range(0, len(qi), step):
            part = qi[start:start + step]
            yield part, np.round(q[part] @ u[ui].T, DIGITS)

    return blocks


def _slices(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows`` in a list that holds row r from starts[r] on, and which of ``rows`` each belongs to."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return within + np.repeat(starts[rows], sizes), np.repeat(np.arange(len(rows)), sizes)


def bm25_kernel(questions: pa.Table, units: pa.Table) -> Callable:
    """Questions carry ``terms`` with their ``idf`` and the ``avgdl`` of their database; units carry ``tokens``."""
    q_lists, u_lists = questions["terms"].combine_chunks(), units["tokens"].combine_chunks()
    q_len, u_len = np.diff(q_lists.offsets.to_numpy()), np.diff(u_lists.offsets.to_numpy())
    encoded = q_lists.flatten().dictionary_encode()
    vocabulary = encoded.dictionary
    q_codes = encoded.indices.to_numpy(zero_copy_only=False)
    q_idf = questions["idf"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    avgdl = questions["avgdl"].to_numpy()
    # Term frequencies of the asked terms only.
    found = pc.index_in(u_lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(u_len), dtype=np.int64), u_len)[found >= 0]
    width = max(1, len(vocabulary))
    cells, tf = np.unique(rows * width + found[found >= 0], return_counts=True)
    u_codes = cells % width
    # Postings lie in row order, so those of some rows are slices: a key costs what its own rows hold.
    u_starts = np.searchsorted(cells, np.arange(len(u_len) + 1) * width)
    q_starts = np.concatenate([[0], np.cumsum(q_len)])

    def blocks(qi: np.ndarray, ui: np.ndarray):
        mine, cols = _slices(u_starts, ui)
        codes, counts = u_codes[mine], tf[mine]
        length = 1 - B + B * u_len[ui] / (avgdl[qi[0]] or 1.0)
        gain = counts * (K1 + 1) / (counts + K1 * length[cols])
        order = np.argsort(codes, kind="stable")
        cols, codes, gain = cols[order], codes[order], gain[order]
        step = max(1, CELLS // max(1, len(ui)))
        for start in range(0, len(qi), step):
            part = qi[start:start + step]
            asked, a_rows = _slices(q_starts, part)
            a_codes, a_idf = q_codes[asked], q_idf[asked]
            by_term = np.argsort(a_codes, kind="stable")
            a_rows, a_codes, a_idf = a_rows[by_term], a_codes[by_term], a_idf[by_term]
            scores = np.zeros((len(part), len(ui)))
            terms, first = np.unique(a_codes, return_index=True)
            for term, lo, hi in zip(terms, first, [*first[1:], len(a_codes)]):
                left, right = np.searchsorted(codes, [term, term + 1])
                if right > left:
                    scores[np.ix_(a_rows[lo:hi], cols[left:right])] += a_idf[lo:hi, None] * gain[None, left:right]
            yield part, np.where(scores > 0, np.round(scores, DIGITS), -np.inf)

    return blocks


KERNELS = {"cosine": cosine_kernel, "bm25": bm25_kernel}


def local_hits(kernel: str | Callable, questions: pa.Table, units: pa.Table, k: int) -> pa.Table:
    """``k`` best units per question among the given units of the question's own key."""
    units = units.take(pc.sort_indices(units["unit_id"]))  # so that column order is the tie order
    out_q, out_u, out_s = [], [], []
    if len(questions) and len(units):
        blocks = (KERNELS[kernel] if isinstance(kernel, str) else kernel)(questions, units)
        unit_rows = _by_key(units["key"])
        for key, qi in _by_key(questions["key"]).items():
            ui = unit_rows.get(key)
            if ui is None:
                continue
            for part, scores in blocks(qi, ui):
                rows, cols = best_cells(scores, k)
                out_q.append(part[rows])
                out_u.append(ui[cols])
                out_s.append(scores[rows, cols])
    pick = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    score = np.concatenate(out_s) if out_s else np.zeros(0)
    return pa.table(
        {
            "question_id": questions["question_id"].take(pa.array(pick(out_q))),
            "unit_id": units["unit_id"].take(pa.array(pick(out_u))),
            "score": pa.array(score, pa.float64()),
        }
    )


def merge_hits(a: pa.Table | None, b: pa.Table, k: int) -> pa.Table:
    if a is None:
        return b
    both = pa.concat_tables([a, b])
    both = both.take(pc.sort_indices(both, sort_keys=[("question_id", "ascending"), ("score", "descending"), ("unit_id", "ascending")]))
    codes = both["question_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.searchsorted(codes, codes)  # codes ascend, as the ids are sorted
    return both.filter(pa.array(np.arange(len(codes)) - starts < k))
