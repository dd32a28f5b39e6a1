"""Counts, weights and scores of token bags: a batch of documents at a time, in NumPy.

Documents come as one array of tokens and their sizes.  Every sum runs in one
stated order, document by document, so that equal documents have equal scores
however they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TOKENS = 1 << 20  # tokens that are worked on at once
CELLS = 4 << 20  # cells of a table of features by documents
PLACES = 9


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column of arrays, one after another, and the arrays' sizes."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.diff(column.offsets.to_numpy()).astype(np.int64)


def lists(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(tokens, pa.int64()))


def parts(sizes: np.ndarray, limit: int | None = None, tokens: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``tokens`` (TOKENS) tokens and up to ``limit`` documents."""
    ends, first, tokens = np.cumsum(sizes), 0, tokens or TOKENS
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + tokens, "right")))
        last = min(last, len(sizes), first + limit if limit else len(sizes))
        yield first, last
        first = last


def owners(sizes: np.ndarray) -> np.ndarray:
    """The document's number of each token."""
    return np.repeat(np.arange(len(sizes)), sizes)


def coded(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens, sorted, and each token's place among them."""
    if len(flat) and flat.min() >= 0 and flat.max() < 4 * TOKENS:
        there = np.zeros(int(flat.max()) + 1, bool)
        there[flat] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[flat]
    return np.unique(flat, return_inverse=True)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def statistics(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, a, b, occurrences and documents of every token (n = 1, b = 0) and every two neighbours (n = 2)."""
    names, at = coded(flat)
    own, v = owners(sizes), max(1, len(names))
    follow = own[1:] == own[:-1]
    kinds = [(at, own)] + [((at[:-1] * v + at[1:])[follow], own[:-1][follow])]
    out = []
    for n, (code, doc) in enumerate(kinds, 1):
        codes, place = (np.arange(v), code) if n == 1 else coded(code)
        k = max(1, len(codes))
        each, times = runs(doc * k + place)
        seen = each % k
        cnt, df = np.bincount(seen, times, k).astype(np.int64), np.bincount(seen, minlength=k)
        some = np.flatnonzero(df)
        codes = codes[some]
        a, b = (names[codes], np.zeros(len(codes), np.int64)) if n == 1 else (names[codes // v], names[codes % v])
        out.append((np.full(len(codes), n, np.int32), a, b, cnt[some], df[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Vocabulary:
    """Features with their factors, numbered by (n, a, b)."""

    def __init__(self, n: np.ndarray, a: np.ndarray, b: np.ndarray, idf: np.ndarray):
        order = np.lexsort((b, a, n))
        self.n, self.a, self.b, self.idf = (np.asarray(x)[order] for x in (n, a, b, idf))
        self.names = np.unique(np.concatenate([self.a, self.b[self.n == 2]])).astype(np.int64)
        self.split = int((self.n == 1).sum())
        self.one = np.searchsorted(self.names, self.a[: self.split])
        self.two = np.searchsorted(self.names, self.a[self.split :]) * len(self.names) + np.searchsorted(self.names, self.b[self.split :])

    def found(self, flat: np.ndarray, sizes: np.ndarray, with_bigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, feature and count of the features that documents have, in order."""
        own, f = owners(sizes), len(self.n)
        none = np.zeros(0, np.int64)
        if not f or not len(flat):
            return none, none, none
        distinct, place = coded(flat)
        known = np.searchsorted(self.names, distinct)
        known = np.where(np.append(self.names, -1)[known] == distinct, known, -1)
        at = known[place]
        to_one = np.full(len(self.names) + 1, -1)
        to_one[self.one] = np.arange(self.split)
        feature = to_one[at]
        some = feature >= 0
        keys = [own[some] * f + feature[some]]
        if with_bigrams and len(self.two):
            ok = (own[1:] == own[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
            code = at[:-1][ok] * len(self.names) + at[1:][ok]
            if len(self.names) <= 1024:
                to_two = np.full(len(self.names) ** 2, -1)
                to_two[self.two] = np.arange(len(self.two))
                place = to_two[code]
            else:
                place = np.minimum(np.searchsorted(self.two, code), len(self.two) - 1)
                place = np.where(self.two[place] == code, place, -1)
            some = place >= 0
            keys.append(own[:-1][ok][some] * f + self.split + place[some])
        each, cnt = runs(np.concatenate(keys))
        return each // f, each % f, cnt

    def weights(self, flat: np.ndarray, sizes: np.ndarray, with_bigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, feature and weight: count over length times the factor, of joint norm 1; zero weights are left out."""
        doc, feature, cnt = self.found(flat, sizes, with_bigrams)
        n = np.where(feature < self.split, sizes[doc], sizes[doc] - 1)
        w = cnt / np.maximum(n, 1) * self.idf[feature]
        some = w != 0
        doc, feature, w = doc[some], feature[some], w[some]
        norm = np.sqrt(np.bincount(doc, w * w, len(sizes)))
        return doc, feature, w / norm[doc]


def rounded(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5), x) / 10.0**places + 0.0


class Scorer:
    """Queries, as vectors, against batches of documents.

    cosine: both sides are unit vectors.  Else a document's counts meet the
    query's weights as they are.
    """

    def __init__(self, vocabulary: Vocabulary, with_bigrams: bool, query: np.ndarray, feature: np.ndarray, weight: np.ndarray, n_queries: int, cosine: bool = True):
        self.vocabulary, self.with_bigrams, self.cosine, self.n_queries = vocabulary, with_bigrams, cosine, n_queries
        self.used, column = np.unique(feature, return_inverse=True)
        self.column = np.full(len(vocabulary.n), -1)
        self.column[self.used] = np.arange(len(self.used))
        at = np.searchsorted(query, np.arange(n_queries + 1))
        self.vectors = [(column[x:y], weight[x:y, None]) for x, y in zip(at[:-1], at[1:], strict=True)]
        self.has_vector = np.diff(at) > 0

    @property
    def limit(self) -> int:
        """How many documents to score at once."""
        return max(16, min(1024, CELLS // max(1, len(self.used), self.n_queries)))

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, documents) of rounded scores, and whether each document has a vector."""
        doc, feature, w = (self.vocabulary.weights if self.cosine else self.vocabulary.found)(flat, sizes, self.with_bigrams)
        has = np.zeros(len(sizes), bool)
        has[doc] = True
        column = self.column[feature]
        some = column >= 0
        table = np.zeros((len(self.used), len(sizes)))
        table[column[some], doc[some]] = w[some]
        out = np.zeros((self.n_queries, len(sizes)))
        for k, (columns, weight) in enumerate(self.vectors):
            if len(columns):
                # along the first axis: one feature after another, for each document alone
                np.add.reduce(weight * table[columns], axis=0, out=out[k])
        return rounded(out), has


def merged(flat: np.ndarray, sizes: np.ndarray, rules: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and sizes after one greedy pass, left to right, of pairs that don't overlap.

    Within a maximal run of positions whose pair has a rule, the first, third,
    ... are merged.
    """
    if len(flat) < 2 or not rules:
        return flat, sizes
    distinct, place = coded(flat)
    known = {int(t): i for i, t in enumerate(distinct)}
    codes = sorted((known[a] * len(distinct) + known[b], new) for (a, b), new in rules.items() if a in known and b in known)
    if not codes:
        return flat, sizes
    left, new = np.array([c for c, _ in codes]), np.array([n for _, n in codes], np.int64)
    own = owners(sizes)
    code = place[:-1] * len(distinct) + place[1:]
    at = np.minimum(np.searchsorted(left, code), len(left) - 1)
    ok = np.append((left[at] == code) & (own[1:] == own[:-1]), False)
    # how far each place is from the last one without a rule; a document's last place never has one
    last = np.maximum.accumulate(np.where(ok, -1, np.arange(len(flat))))
    starts = ok & ((np.arange(len(flat)) - last) % 2 == 1)
    out = flat.copy()
    out[starts] = new[at[starts[:-1]]]
    kept = np.append(True, ~starts[:-1])
    return out[kept], np.bincount(own[kept], minlength=len(sizes))
