"""Alignment kernels: one query against a padded batch of documents, a row at a time.

The inner loop of both recurrences is a prefix maximum or minimum, so each query
token costs a few NumPy passes over the batch:

* local alignment with linear gaps g: with T_j the best of 0, the diagonal and
  the cell above less g, the row is cummax(T_j + g j) - g j;
* warping with 0/1 costs: with P the running sums of the row's costs, the row
  is P + cummin(least of the two cells above - P before).

Cells of padding never raise a score: gaps only lower what they carry on.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

BIG = 1e6
FAR = 1 << 28  # beyond any sum of 0/1 costs
BATCH_CELLS = 4 << 20
WARP_CELLS = 1 << 16
WARP_QUERIES, WARP_PAIRS = 200, 12_800


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents as one matrix of codes, padded with -1, and their lengths."""
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.full((len(docs), max(1, int(sizes.max(initial=0)))), -1, np.int64)
    for row, d in zip(out, docs, strict=True):
        row[: len(d)] = d
    return out, sizes


def batches(order: Iterable[int], sizes: np.ndarray, cells: int | None = None) -> Iterable[list[int]]:
    """Row numbers by length, cut so that a padded batch has about ``cells`` (BATCH_CELLS) cells."""
    cells = cells or BATCH_CELLS
    batch: list[int] = []
    for i in sorted(order, key=lambda i: sizes[i]):
        if batch and (len(batch) + 1) * sizes[i] > cells:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def local_scores(query: np.ndarray, docs: np.ndarray, gains, gap: float) -> np.ndarray:
    """Best local score of each document; gains(token) gives the batch's gain for a query token."""
    n, width = docs.shape
    ramp = gap * np.arange(1, width + 1)
    prev, best = np.zeros((n, width + 1)), np.zeros(n)
    if not width:
        return best
    pad = docs < 0
    for token in query:
        gain = np.where(pad, -BIG, gains(int(token)))
        row = np.maximum(0.0, np.maximum(prev[:, :-1] + gain, prev[:, 1:] - gap))
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        prev[:, 1:] = row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def smith_waterman(query: np.ndarray, docs: list[np.ndarray], match: float = 2.0, mismatch: float = -1.0, gap: float = 2.0) -> np.ndarray:
    """Scores of one query against documents; 0 where either is empty."""
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs))
    for batch in batches(range(len(docs)), sizes):
        matrix, _ = padded([docs[i] for i in batch])
        out[batch] = local_scores(query, matrix, lambda t, m=matrix: np.where(m == t, match, mismatch), gap)
    return out


def smith_waterman_soft(query: np.ndarray, docs: list[np.ndarray], lookup: dict[int, dict[int, float]], match: float = 2.0, missing: float = -1.0, gap: float = 2.0, scale: float = 1.0) -> np.ndarray:
    """As above, but unequal tokens x, y gain scale * lookup[x][y] if that is there."""
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs))
    for batch in batches(range(len(docs)), sizes):
        matrix, _ = padded([docs[i] for i in batch])
        codes, at = np.unique(matrix, return_inverse=True)
        at = at.reshape(matrix.shape)

        def gains(token: int, codes=codes, at=at) -> np.ndarray:
            known = lookup.get(token, {})
            own = np.array([match if c == token else scale * known[c] if c in known else missing for c in codes.tolist()])
            return own[at]

        out[batch] = local_scores(query, matrix, gains, gap)
    return out


def dtw(query: np.ndarray, docs: list[np.ndarray], window: int | None = None) -> np.ndarray:
    """Warping distances with 0/1 costs over the query's length; the band is at least the difference of lengths.

    An empty query or document is at infinity.
    """
    return dtw_many([query], docs, window)[0]


def dtw_many(queries: list[np.ndarray], docs: list[np.ndarray], window: int | None = None) -> np.ndarray:
    """(queries, documents) of `dtw`.

    Padding stands behind a document's last cell, and no cell looks ahead.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.full((len(queries), len(docs)), np.inf)
    if window is None:
        _warp_all(queries, docs, sizes, out)
        return out
    for batch in batches([i for i in range(len(docs)) if sizes[i]], sizes, WARP_CELLS):
        matrix, size = padded([docs[i] for i in batch])
        rows, width = matrix.shape
        costs: dict[int, np.ndarray] = {}
        last = np.arange(rows)
        for k, query in enumerate(queries):
            if not len(query):
                continue
            band = np.maximum(window, np.abs(len(query) - size))
            out[k, batch] = _warped(query, matrix, size, costs, band)[last, size] / len(query)
    return out


def _warp_all(queries: list[np.ndarray], docs: list[np.ndarray], sizes: np.ndarray, out: np.ndarray) -> None:
    """Fills out without a band: a place of the documents after another, all queries and documents of a batch at once.

    Queries and documents go by length, so that padding is small; a document
    leaves the batch at its last place.
    """
    asked = sorted((k for k in range(len(queries)) if len(queries[k])), key=lambda k: len(queries[k]))
    given = sorted((i for i in range(len(docs)) if sizes[i]), key=lambda i: -sizes[i])
    for x in range(0, len(asked), WARP_QUERIES):
        names = asked[x : x + WARP_QUERIES]
        lengths = np.array([len(queries[k]) for k in names])
        m = int(lengths.max())
        tokens, flat = np.unique(np.concatenate([queries[k] for k in names]), return_inverse=True)
        code = np.zeros((m, len(names)), np.int64)
        for q, part in enumerate(np.split(flat, np.cumsum(lengths)[:-1])):
            code[: len(part), q] = part
        step = max(16, min(1024, WARP_PAIRS // len(names)))
        for y in range(0, len(given), step):
            batch = given[y : y + step]
            matrix, size = padded([docs[i] for i in batch])
            # no distance exceeds both lengths together
            kind, far = (np.int16, 1 << 14) if m + matrix.shape[1] < 1 << 14 else (np.int32, FAR)
            place = np.full((matrix.shape[1], len(batch)), len(tokens))
            at = np.minimum(np.searchsorted(tokens, matrix.T), len(tokens) - 1)
            place = np.where(tokens[at] == matrix.T, at, place)
            prev, cur = np.full((2, m + 1, len(names), len(batch)), far, kind)
            prev[0] = 0
            cost, differ = np.empty(prev[1:].shape, kind), np.empty((len(tokens) + 1, len(batch)), kind)
            best = np.zeros((len(names), len(batch)))
            active = len(batch)
            for j in range(matrix.shape[1]):
                while size[active - 1] <= j:
                    active -= 1
                if active < prev.shape[2]:
                    prev, cur, cost, differ = (np.ascontiguousarray(x[..., :active]) for x in (prev, cur, cost, differ))
                differ[:] = 1
                differ[place[j, :active], np.arange(active)] = 0
                np.take(differ, code, axis=0, out=cost, mode="clip")
                np.minimum(prev[1:], prev[:-1], out=cur[1:])
                cur[1:] += cost
                cur[0] = far
                for i in range(1, m + 1):
                    cost[i - 1] += cur[i - 1]
                    np.minimum(cur[i], cost[i - 1], out=cur[i])
                ended = np.flatnonzero(size[:active] == j + 1)
                if len(ended):
                    best[:, ended] = cur[:, :, ended][lengths, np.arange(len(names))]
                prev, cur = cur, prev
            out[np.ix_(names, batch)] = best / lengths[:, None]


def _warped(query: np.ndarray, matrix: np.ndarray, size: np.ndarray, costs: dict[int, np.ndarray], band: np.ndarray) -> np.ndarray:
    """The last row of each document's table, its first cell for nothing of the document."""
    rows, width = matrix.shape
    prev = np.full((rows, width + 1), FAR, np.int32)
    prev[:, 0] = 0
    above = np.empty((rows, width), np.int32)
    for i, token in enumerate(query.tolist(), 1):
        if token not in costs:
            costs[token] = np.zeros((rows, width + 1), np.int32)
            np.cumsum(matrix != token, axis=1, out=costs[token][:, 1:])
        cost = costs[token]
        np.minimum(prev[:, 1:], prev[:, :-1], out=above)
        above -= cost[:, :-1]
        outside = np.abs(np.arange(1, width + 1) - i) > band[:, None]
        above[outside] = FAR
        np.minimum.accumulate(above, axis=1, out=above)
        np.add(above, cost[:, 1:], out=prev[:, 1:])
        prev[:, 1:][outside] = FAR
        prev[:, 0] = FAR
    return prev
