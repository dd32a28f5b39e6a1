"""Alignment kernels against cell-by-cell recurrences."""

import functools
import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import kernels

SEQ = st.lists(st.integers(0, 4), max_size=12)


def local(q, d, gain, gap):
    """The best over all places where an alignment may end, each by its last step."""

    @functools.cache
    def ending(i, j):
        """The best alignment that ends before q[i] and d[j], an empty one too."""
        if i == 0 or j == 0:
            return 0
        return max(0, ending(i - 1, j - 1) + gain(q[i - 1], d[j - 1]), ending(i - 1, j) - gap, ending(i, j - 1) - gap)

    return max((ending(i, j) for i in range(len(q) + 1) for j in range(len(d) + 1)), default=0)


def warp(q, d, window):
    """The cheapest walk from corner to corner of the grid of pairs, by always going on from the cheapest pair reached."""
    if not len(q) or not len(d):
        return np.inf
    reach = max(len(q), len(d)) if window is None else max(window, abs(len(q) - len(d)))
    queue, done = [(int(q[0] != d[0]), 0, 0)], set()
    while queue:
        paid, i, j = heapq.heappop(queue)
        if (i, j) == (len(q) - 1, len(d) - 1):
            return paid / len(q)
        if (i, j) in done:
            continue
        done.add((i, j))
        for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
            if x < len(q) and y < len(d) and abs(x - y) <= reach:
                heapq.heappush(queue, (paid + int(q[x] != d[y]), x, y))
    return np.inf


def arrays(seqs):
    return [np.array(s, np.int64) for s in seqs]


@settings(max_examples=150, deadline=None)
@given(SEQ, st.lists(SEQ, max_size=5))
def test_hard(q, docs):
    got = kernels.smith_waterman(np.array(q, np.int64), arrays(docs))
    assert got.tolist() == [local(q, d, lambda x, y: 2 if x == y else -1, 2) for d in docs]


@settings(max_examples=150, deadline=None)
@given(SEQ, st.lists(SEQ, max_size=5), st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.floats(-1, 5), max_size=10))
def test_soft(q, docs, table):
    lookup = {}
    for (x, y), s in table.items():
        lookup.setdefault(x, {})[y] = s
    got = kernels.smith_waterman_soft(np.array(q, np.int64), arrays(docs), lookup, scale=0.5)
    want = [local(q, d, lambda x, y: 2 if x == y else 0.5 * table.get((x, y), -2.0), 2) for d in docs]
    assert np.allclose(got, want)


@settings(max_examples=200, deadline=None)
@given(SEQ, st.lists(SEQ, max_size=5), st.sampled_from([None, 0, 1, 2, 5, 20]))
def test_warping(q, docs, window):
    got = kernels.dtw(np.array(q, np.int64), arrays(docs), window)
    assert np.allclose(got, [warp(q, d, window) for d in docs])


@pytest.mark.parametrize("cells", [4 << 20, 30])
def test_batches_hold_all(cells, monkeypatch):
    monkeypatch.setattr(kernels, "BATCH_CELLS", cells)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5, n) for n in (0, 3, 50, 7, 7, 1)]
    q = rng.integers(0, 5, 9)
    assert kernels.smith_waterman(q, docs).tolist() == [local(q, d, lambda x, y: 2 if x == y else -1, 2) for d in docs]


def test_warping_of_many_queries():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5, n) for n in (0, 3, 50, 7, 700, 1)]
    queries = [rng.integers(0, 5, n) for n in (4, 0, 30)]
    got = kernels.dtw_many(queries, docs)
    assert np.allclose(got, [[warp(q, d, None) for d in docs] for q in queries])
