"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of words and of word beginnings
(``PREFIXES`` bytes long) in the whole text.  It is fitted on at most ``SAMPLE``
labelled documents (those of least hash), on the driver.

Group mentions must not decide: in labelled sentences that name a group, the
term is swapped for others of its set, and the squared change of the score is
penalised; where the sample has too few such sentences, a mention is put at the
end of others, and swapped there.  So a term carries weight only as far as all
terms of its set do, and a neutral mention is not taken for an attack.

Features are those that at least ``LEAST`` documents of the sample have and
that tell the classes apart beyond chance: their likelihood ratio G is over
``2 ln m`` for m such features, which chance alone passes about once (at most the
``TOP`` largest), and those of the group terms.  Empty and null texts have the score of a text without features.  Labels
without a document, null labels and null ids are ignored; of several labels of
an id the largest holds.  Without any label the score is 0.5 for all.  Columns
of the input named score or predicted are replaced; the others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .scan import with_text_columns

SAMPLE = 8_000
PREFIXES = (3, 4, 5, 6, 8)
LEAST = 4
TOP = 8192
TABLE_BITS = 24
RIDGE = 5e-5
FAIRNESS = 4.0
MENTIONS = 400
LIMIT = 0.7
#: Sets of group terms that are swapped for each other.
GROUPS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes", "musulmans", "juifs", "immigrés", "étrangers"),
    ("frauen", "männer", "muslime", "juden", "einwanderer", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "judíos", "inmigrantes", "extranjeros"),
)

_AZ, _TERM = re.compile("[A-Z]"), re.compile("[a-z\x80-\U0010ffff]+")
_WORD = np.zeros(256, bool)
_WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(c: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning of a chunk, repeated or not."""
    low = ts.LOWER[c.buf]
    w = ts.runs(_WORD[low], c.at)
    pre, rows, size = ts.prefix(low), w.rows, w.end - w.start
    all_rows, hashes = [rows], [ts.span_hash(pre, w.start, w.end)]
    for k in PREFIXES:
        own = size >= k
        all_rows.append(rows[own])
        hashes.append(ts.mix(ts.span_hash(pre, w.start[own], w.start[own] + k) + ts.U64(k)))
    return np.concatenate(all_rows), np.concatenate(hashes)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, hash) of texts, a chunk at a time."""
    for c in ts.chunks(texts):
        r, h = features(c)
        at = np.unique(ts.mix(h + r.astype(ts.U64) * ts.U64(ts._R)), return_index=True)[1]
        yield r[at] + c.first, h[at]


def _of_texts(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of texts; only those whose table cell is wanted, if given."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, ts.U64)]
    for r, h in _pieces(texts):
        own = slice(None) if wanted is None else wanted[_cell(h)]
        rows.append(r[own])
        hashes.append(h[own])
    return np.concatenate(rows), np.concatenate(hashes)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> ts.U64(64 - TABLE_BITS)).astype(np.int64)


class Model:
    """Sorted feature hashes with their weights."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.names, self.weights, self.bias = names, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(names >> ts.U64(44)).astype(np.int64)] = True

    def known(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature number) of those that the model has."""
        on = self.maybe[(hashes >> ts.U64(44)).astype(np.int64)]
        rows, hashes = rows[on], hashes[on]
        k = np.minimum(np.searchsorted(self.names, hashes), max(len(self.names) - 1, 0))
        on = self.names[k] == hashes if len(self.names) else np.zeros(len(k), bool)
        both = np.unique(rows[on] * len(self.names) + k[on])
        return both // max(len(self.names), 1), both % max(len(self.names), 1)

    def scores(self, c: ts.Chunk) -> np.ndarray:
        rows, k = self.known(*features(c))
        z = np.bincount(rows, self.weights[k], minlength=len(c)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def swaps(texts: list[str]) -> list[tuple[str, str]]:
    """Pairs of labelled sentences that differ in a group term alone."""
    group_of = {t: g for g in GROUPS for t in g}
    pairs: list[tuple[str, str]] = []
    plain: list[str] = []
    for text in texts:
        for sentence in text.split("\n"):
            low = _AZ.sub(lambda m: m[0].lower(), sentence)
            words = list(_TERM.finditer(low))  # the words that features are made of
            named = [m for m in words if m[0] in group_of]
            if named:
                if len(pairs) < MENTIONS * 4:
                    pairs += [(low, low[: m.start()] + t + low[m.end() :]) for m in named for t in group_of[m[0]] if t != m[0]]
            elif 4 <= len(words) <= 60 and len(plain) < MENTIONS:
                plain.append(sentence)
    for i, sentence in enumerate(plain):
        g = GROUPS[i % len(GROUPS)]
        pairs += [(f"{sentence} {g[j]}", f"{sentence} {g[j - 1]}") for j in range(len(g))]
    return pairs


def likelihood_ratio(bad: np.ndarray, good: np.ndarray, all_bad: float, all_good: float) -> np.ndarray:
    """G of each feature's table of presence by class."""
    n, total = all_bad + all_good, np.zeros(len(bad))
    for seen, row, column in ((bad, bad + good, all_bad), (good, bad + good, all_good), (all_bad - bad, n - bad - good, all_bad), (all_good - good, n - bad - good, all_good)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, 2 * seen * np.log(seen * n / (row * column)), 0)
    return total


def fit_texts(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The model of a sample of texts and labels.

    The first of two passes counts features in a table of 2**TABLE_BITS cells;
    the second keeps those of cells that may tell the classes apart, and counts
    them exactly.  So memory is that of the table, not of all features.
    """
    y = np.asarray(toxic, np.float64)
    kind = np.uint16 if len(y) < 1 << 16 else np.uint32
    seen, seen_bad = np.zeros(1 << TABLE_BITS, kind), np.zeros(1 << TABLE_BITS, kind)
    for r, h in _pieces(texts):
        np.add.at(seen, _cell(h), 1)
        np.add.at(seen_bad, _cell(h[y[r] > 0]), 1)
    often = np.flatnonzero(seen >= LEAST)
    chance = 2 * np.log(max(len(often), 2))
    found = likelihood_ratio(seen_bad[often].astype(float), seen[often] - seen_bad[often].astype(float), y.sum(), len(y) - y.sum())
    wanted = np.zeros(1 << TABLE_BITS, bool)
    wanted[often[found > chance / 2]] = True
    terms = _of_texts(pa.array([t for g in GROUPS for t in g]))[1]
    wanted[_cell(terms)] = True
    rows, hashes = _of_texts(texts, wanted)
    names, which = np.unique(hashes, return_inverse=True)
    with_it = np.bincount(which, minlength=len(names))
    bad = np.bincount(which, y[rows], minlength=len(names))
    gain = np.where(with_it >= LEAST, likelihood_ratio(bad, with_it - bad, y.sum(), len(y) - y.sum()), 0)
    best = np.argsort(-gain, kind="stable")[: min(TOP, int((gain > chance).sum()))]
    model = Model(np.union1d(names[best], terms), np.zeros(0), 0.0)
    r, k = model.known(rows, hashes)
    n = len(model.names)
    pairs = swaps(texts.to_pylist())
    (ra, ka), (rb, kb) = (model.known(*_of_texts(pa.array([x[i] for x in pairs], pa.string()))) for i in (0, 1))
    dr, dk, ds = np.concatenate([ra, rb]), np.concatenate([ka, kb]), np.concatenate([np.ones(len(ra)), -np.ones(len(rb))])

    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w, bias = np.zeros(n), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, 401):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[k], minlength=len(y)) + bias, -35, 35)))
        err = (s - y) / len(y)
        grad = np.bincount(k, err[r], minlength=n) + RIDGE * w
        if pairs:
            change = np.bincount(dr, ds * w[dk], minlength=len(pairs))
            grad += FAIRNESS / len(pairs) * np.bincount(dk, ds * change[dr], minlength=n)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias = bias - 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    model.weights, model.bias = w, bias
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic) to learn from.

    The sample is the labelled ids of least hash, so it is the same however the
    tables are cut; texts are read whole.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    low = known.select(F.xxhash64("doc_id").alias("h"), "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").select("h")
    last = low.orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return Model(np.zeros(0, ts.U64), np.zeros(0), 0.0)
    rows = docs.filter(F.xxhash64("doc_id") <= last).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("doc_id", "text", "toxic").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).slice(0, sample)
    return fit_texts(rows["text"].combine_chunks(), rows["toxic"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score and predicted."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(c: ts.Chunk) -> dict:
            s = told.value.scores(c)
            return {"score": s, "predicted": (s >= LIMIT).astype(np.int32)}

        return of

    return with_text_columns(docs, text, "score double, predicted int", make, drop)
