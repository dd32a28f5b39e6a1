r"""Quality rules with risk-controlled cutoffs.

Every document gets counts (words ``[^\x20\x09-\x0D]+`` of its whole text):

* a base rule with fixed limits, and
* five rates (symbols, repeated words, repeated lines, capitals, exclamation
  marks), each put on integer levels 0 to ``LEVELS``.

A document is rejected by a rate whose level reaches the cutoff of its stratum
(its ``lang``; null is the stratum ``''``).  Cutoffs come from labelled good
documents, which took no part in the making of the rules: from the most lenient
cutoff on, each stricter one is accepted while the exact binomial test refutes
"it rejects more than ``alpha / rules`` of the good documents of this stratum"
at level ``delta / (rules * strata)``; the first that isn't refuted ends the
sequence (fixed-sequence testing needs no further correction along a sequence;
Bonferroni corrects for rules and strata).  So with probability ``1 - delta``
no stratum loses more than ``alpha`` of its good documents, whichever of the
accepted cutoffs is taken.  The one taken rejects the most labelled bad
documents less labelled good ones (ties: the most lenient).  A stratum with too
few labels gets no cutoff and loses nothing.

The promise is about the rates; what the base rule rejects is not counted.

Nulls and empty texts have no words and fail the base rule.  A document is one
trial: labels of an id that are repeated count once, those that disagree not at
all, and of rows that share an id and stratum the highest level of each rate
counts.  Labels without a document, null labels and null ids are ignored.
Empty tables give empty results.  Columns of the input that have the name of a
count, base_failed or kept are replaced; the others stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .scan import with_text_columns
from .store import keep

LEVELS = 64
ALPHA = 0.05
DELTA = 0.05
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
WINDOW = 8
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_caps long, n_marks long"
#: Rule: what is counted, of how many.
RATES = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"), "caps": ("n_caps", "word_chars"), "marks": ("n_marks", "n_words")}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count_chunk(c: ts.Chunk) -> dict:
    """The columns of COUNTS for the rows of a chunk."""
    inside = ts.NOT_SPACE[c.buf]
    words = ts.runs(inside, c.at)
    pre = ts.prefix(c.buf)
    n = len(c)
    lines = ts.lines(c)
    filled = np.concatenate([[0], np.cumsum(inside)])
    with_word = filled[lines.end] > filled[lines.start]
    row = lines.rows[with_word]
    key = ts.mix(ts.span_hash(pre, lines.start[with_word], lines.end[with_word]) + row.astype(ts.U64) * ts.U64(ts._R))
    distinct = np.unique(key, return_index=True)[1]
    n_lines = np.bincount(row, minlength=n)

    first, win = ts.windows(ts.span_hash(pre, words.start, words.end), words.row_at, WINDOW)
    rows = np.searchsorted(words.row_at, first, "right") - 1
    win = ts.mix(win + rows.astype(ts.U64) * ts.U64(ts._R))
    order = np.argsort(win, kind="stable")
    same = np.zeros(len(win) + 1, bool)
    same[1:-1] = win[order][1:] == win[order][:-1]
    again = first[order[same[1:] | same[:-1]]]
    step = np.zeros(len(words.start) + WINDOW + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    covered = np.cumsum(step)[: len(words.start)] > 0
    return {
        "n_words": words.counts,
        "word_chars": ts.sums(inside & ((c.buf & 0xC0) != 0x80), c.at),
        "n_symbols": ts.sums(_SYMBOL[c.buf], c.at),
        "n_dup_lines": n_lines - np.bincount(row[distinct], minlength=n),
        "n_repeat_words": ts.sums(covered, words.row_at),
        "n_lines": n_lines,
        "n_caps": ts.sums((c.buf >= 0x41) & (c.buf <= 0x5A), c.at),
        "n_marks": ts.sums(c.buf == 0x21, c.at),
    }


def counts(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the columns of COUNTS."""
    return with_text_columns(docs, text, COUNTS, lambda: count_chunk, drop)


def level(rule: str) -> Column:
    part, of = RATES[rule]
    return F.expr(f"least({LEVELS}L, ({LEVELS}L * {part}) div greatest({of}, 1L))")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def refuted(bad: int, n: int, risk: float, size: float) -> bool:
    """Whether P(Bin(n, risk) <= bad) <= size: the exact one-sided test of "the risk is greater"."""
    if not n or bad >= risk * n:
        return False
    total = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk)) for i in range(bad + 1))
    return total <= size


def cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): of the cutoffs that the labelled good documents allow, the most useful one.

    counted has doc_id, lang and COUNTS.  Only counts by stratum, rule and
    level leave the executors' partial sums: at most LEVELS + 1 rows for each
    stratum and rule reach one group.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("best")).filter("good = best").select("doc_id", "good")
    levels = counted.filter(~base_failed()).select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *(level(r).alias(r) for r in RATES)).join(known, "doc_id")
    each = levels.groupBy("doc_id", "stratum").agg(F.max("good").alias("good"), *(F.max(r).alias(r) for r in RATES))
    rated = each.select("good", "stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RATES))).alias("x"))
    sizes = rated.groupBy("stratum", "x.rule", "x.level").agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"))
    strata = sizes.select(F.count_distinct("stratum").alias("strata"))
    risk, rules = alpha / len(RATES), len(RATES)

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(LEVELS + 1, np.int64), np.zeros(LEVELS + 1, np.int64)
        np.add.at(good, pdf["level"].to_numpy(), pdf["n_good"].to_numpy())
        np.add.at(bad, pdf["level"].to_numpy(), pdf["n_bad"].to_numpy())
        n, size = int(good.sum()), delta / (rules * int(pdf["strata"].iloc[0]))
        lost, won, best, cut = 0, 0, 0, LEVELS + 1
        for at in range(LEVELS, 0, -1):
            lost, won = lost + int(good[at]), won + int(bad[at])
            if not refuted(lost, n, risk, size):
                break
            if won - lost > best:
                best, cut = won - lost, at
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "rule": [pdf["rule"].iloc[0]], "cutoff": [cut]})

    return sizes.withColumn("strata", strata.scalar()).groupBy("stratum", "rule").applyInPandas(chosen, "stratum string, rule string, cutoff long")


def learn(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum, with a cutoff column for each rule, kept in the shared folder."""
    found = cutoffs(counted, labels, alpha, delta)
    return keep(found.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RATES)), "quality")


def judge(counted: DataFrame, learned: DataFrame) -> DataFrame:
    """counted with base_failed and kept."""
    counted = counted.drop("base_failed", "kept")
    x = counted.alias("d").join(learned.alias("q"), F.coalesce("d.lang", F.lit("")) == F.col("q.stratum"), "left")
    over = [F.coalesce(level(r) >= F.col(f"q.cut_{r}"), F.lit(False)) for r in RATES]
    return x.select("d.*", base_failed().alias("base_failed"), (~base_failed() & ~F.greatest(*over)).alias("kept"))
