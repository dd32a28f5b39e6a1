"""Language identification by a bit-sliced Bloom filter of byte n-grams.

Text is read as bytes, A-Z lower-cased, all other ASCII but letters as blanks.
An n-gram (``GRAM`` bytes, not blank at both middle bytes) is typical of a
language if at least ``SHARE`` of its weight (its documents by language, over
the language's documents) falls there and ``LEAST`` documents have it.

The filter has ``1 << BITS`` positions; each holds one bit for every language
(the slices).  A query ands the words at ``HASHES`` positions and gets the set
of all languages that contain the n-gram.  The popcounts of a text's n-grams by
language are corrected for false positives, which a slice with a filled share f
gives with probability f ** HASHES, and for how many n-grams of its own texts
a language's slice contains; the largest decides (ties: the language that comes
first), and its part of the sum is the score.

It learns from about ``SAMPLE`` documents of each language (a bounded sample by
a hash of the id; texts whole), from text and non-null lang alone.  A text that
is null or has no letter is ``und`` with score 0; with letters but without any
known n-gram it is the most frequent language with score 1 / languages.  Without
labelled rows everything is ``und``.  Columns of the input named lang_pred or
score are replaced; the others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .bpe import LETTER, classes
from .scan import with_text_columns

GRAM = 4
SAMPLE = 1500
SHARE = 0.7
LEAST = 4
TOP = 200_000
BITS = 22
HASHES = 3

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def grams(c: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a chunk's rows as 32-bit words, and where rows begin among them."""
    b = _FOLD[c.buf].astype(np.uint32)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(c) + 1, np.int64)
    word = b[:n].copy()
    for j in range(1, GRAM):
        word = (word << np.uint32(8)) | b[j : j + n]
    good = ((word >> np.uint32(8)) & np.uint32(0xFFFF)) != 0x2020
    for j in range(1, GRAM):  # not over a row's end
        ends = c.at[1:-1] - j
        good[ends[(ends >= 0) & (ends < n)]] = False
    at = np.flatnonzero(good)
    return word[at], np.searchsorted(at, c.at)


def has_letter(c: ts.Chunk) -> np.ndarray:
    found = ts.sums(_ASCII_LETTER[c.buf], c.at) > 0
    for i in np.flatnonzero(~found & (ts.sums(c.buf >= 0x80, c.at) > 0)).tolist():
        text = c.buf[c.at[i] : c.at[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = bool((classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == LETTER).any())
    return found


class Filter:
    """The slices, and what corrects their popcounts."""

    def __init__(self, langs: list[str], words: np.ndarray, masks: np.ndarray) -> None:
        """masks: bit of each language in which words[i] is typical, in 64-bit columns."""
        self.langs = langs
        self.slices = np.zeros((1 << BITS, masks.shape[1]), np.uint64)
        for at in self.positions(words):
            for k in range(masks.shape[1]):
                np.bitwise_or.at(self.slices[:, k], at, masks[:, k])
        self.chance = np.array([(((self.slices[:, i // 64] >> ts.U64(i % 64)) & ts.U64(1)).mean()) ** HASHES for i in range(len(langs))])
        self.cover = np.ones(len(langs))

    @staticmethod
    def positions(words: np.ndarray) -> list[np.ndarray]:
        h = ts.mix(words.astype(ts.U64) * ts.U64(ts._R))
        return [((h >> ts.U64(21 * j)) & ts.U64((1 << BITS) - 1)).astype(np.int64) for j in range(HASHES)]

    def hits(self, c: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts (rows, languages) and n-grams of each row."""
        words, at = grams(c)
        n = np.diff(at)
        got = np.zeros((len(c), len(self.langs)))
        where = self.positions(words)
        for k in range(self.slices.shape[1]):
            column = self.slices[:, k]
            both = column[where[0]]
            for p in where[1:]:
                both &= column[p]
            for i in range(64 * k, min(len(self.langs), 64 * k + 64)):
                got[:, i] = ts.sums((both >> ts.U64(i % 64)) & ts.U64(1), at)
        return np.maximum(0, (got - n[:, None] * self.chance) / (1 - self.chance)), n

    def predict(self, c: ts.Chunk) -> tuple[list[str], np.ndarray]:
        got = self.hits(c)[0] / self.cover
        total, best = got.sum(axis=1), got.argmax(axis=1)
        score = np.where(total > 0, got.max(axis=1) / np.maximum(total, 1e-300), 1 / len(self.langs))
        known = has_letter(c)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filter | None:
    """docs: (doc_id, text, lang) to learn from; None without labelled text.

    Counts by language and n-gram are summed on the executors; the driver gets
    the typical n-grams, at most TOP of each language.
    """
    docs = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, sample / counts[lang])))
    chosen = docs.filter(part < F.element_at(share, F.col("lang"))).select("lang", "text")
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        seen: dict[int, list[np.ndarray]] = {}
        docs_of = dict.fromkeys(number.values(), 0)
        for b in batches:
            own = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            for c in ts.chunks(b.column(1)):
                words, at = grams(c)
                lang = own[c.first : c.first + len(c)]
                rows = np.repeat(np.arange(len(c)), np.diff(at))
                one = np.unique((rows.astype(np.uint64) << ts.U64(32)) | words)
                rows = (one >> ts.U64(32)).astype(np.int64)
                for i in np.unique(lang).tolist():
                    mine = (one & ts.U64(0xFFFFFFFF))[lang[rows] == i]
                    seen.setdefault(i, []).append(mine)
                    docs_of[i] += int((lang == i).sum())
        for i, found in seen.items():
            words, n = np.unique(np.concatenate(found), return_counts=True)
            words, n = np.append(words.astype(np.int64), -1), np.append(n, docs_of[i])
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(len(words), i), pa.int32()), pa.array(n, pa.int64())], names=["word", "lang", "n"])

    summed = chosen.mapInArrow(count, "word long, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    summed = summed.persist()
    size = {r["lang"]: r["n"] for r in summed.filter("word = -1").collect()}
    weight = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for i, n in size.items() for x in (i, float(n)))), F.col("lang"))
    total = summed.filter("word >= 0").withColumn("w", weight).groupBy("word").agg(F.sum("w").alias("all"), F.collect_list(F.struct("lang", "n", "w")).alias("by"))
    typical = total.select("word", "all", F.explode("by").alias("x")).filter((F.col("x.w") >= SHARE * F.col("all")) & (F.col("x.n") >= LEAST)).select("word", "x.lang", "x.n")
    best = typical.withColumn("k", F.expr("row_number() over (partition by lang order by n desc, word)")).filter(F.col("k") <= TOP).select("word", "lang", "n").toPandas()
    summed.unpersist()
    words, which = np.unique(best["word"].to_numpy(np.int64), return_inverse=True)
    masks = np.zeros((len(words), 1 + (len(langs) - 1) // 64), np.uint64)
    lang = best["lang"].to_numpy(np.int64)
    for k in range(masks.shape[1]):
        own = lang // 64 == k
        np.bitwise_or.at(masks[:, k], which[own], ts.U64(1) << (lang[own] % 64).astype(ts.U64))
    found = Filter(langs, words.astype(np.uint32), masks)
    told = docs.sparkSession.sparkContext.broadcast(found)

    def covered(batches):
        hit, all_of = np.zeros(len(langs)), np.zeros(len(langs))
        for b in batches:
            own = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            for c in ts.chunks(b.column(1)):
                got, n = told.value.hits(c)
                lang = own[c.first : c.first + len(c)]
                np.add.at(hit, lang, got[np.arange(len(c)), lang])
                np.add.at(all_of, lang, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs))), pa.array(hit), pa.array(all_of)], names=["lang", "hit", "n"])

    for r in chosen.mapInArrow(covered, "lang long, hit double, n double").groupBy("lang").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect():
        found.cover[r["lang"]] = max(r["hit"] / max(r["n"], 1), 1e-3)
    return found


def in_part(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is part; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def identify(docs: DataFrame, found: Filter | None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score."""
    told = docs.sparkSession.sparkContext.broadcast(found)

    def make():
        def of(c: ts.Chunk) -> dict:
            if told.value is None:
                return {"lang_pred": ["und"] * len(c), "score": np.zeros(len(c))}
            lang, score = told.value.predict(c)
            return {"lang_pred": lang, "score": score}

        return of

    return with_text_columns(docs, text, "lang_pred string, score double", make, drop)
