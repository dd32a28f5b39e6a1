"""Merging of frequent, closely bound token pairs into new tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bags
from ..sources.shared import stored
from . import stats

TAU_PMI, TAU_IDF, MIN_COUNT, MAX_MERGES = 1.0, 3.0, 2, 50
RULES = 4 << 20


def merge_rules(arrays: DataFrame, tau_pmi: float = TAU_PMI, tau_idf: float = TAU_IDF, min_count: int = MIN_COUNT, max_merges: int | None = MAX_MERGES, counted: DataFrame | None = None) -> DataFrame:
    """(a, b, pmi, new_id) of (id, tokens): bigrams bound by tau_pmi at least, of tokens of idf tau_idf at most.

    New ids follow the largest token, in the order of the PMI (ties: a, b).
    Rules are bounded by max_merges, or by the pairs of the vocabulary.
    counted: the corpus's `stats.counted`, if that is there already.
    """
    counted = stored(stats.counted(arrays), "counted") if counted is None else counted
    unigrams = stats.unigrams_of(counted)
    values = stats.pmi(unigrams, stats.pairs_of(counted), min_count)
    idfs = stats.idf(unigrams.select("tok", "df"), stats.n_docs(arrays))
    chosen = stats.idf_gate(values.filter(F.col("pmi") >= tau_pmi), idfs, tau_idf).select("a", "b", "pmi")
    if max_merges is not None:
        chosen = chosen.orderBy(F.desc("pmi"), "a", "b").limit(max_merges)
    top = unigrams.agg(F.max("tok").alias("m")).scalar()
    number = F.expr("row_number() over (order by pmi desc, a, b)").cast("long")
    return chosen.withColumn("new_id", top + number)


def merge_apply(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, pos, tok) after one pass, left to right, of pairs that don't overlap.

    Within a maximal run of positions whose pair has a rule, the greedy pass
    merges at the first, third, ... position, so it is a window over each
    sequence: the run's number, then the place in the run.  Positions are
    numbered anew.
    """
    follow = tokens.withColumn("b", F.expr("lead(tok) over (partition by id order by pos)"))
    ruled = follow.join(rules.select(F.col("a").alias("tok"), "b", "new_id"), ["tok", "b"], "left").withColumn("ok", F.col("new_id").isNotNull())
    runs = ruled.withColumn("run", F.expr("sum(if(ok, 0, 1)) over (partition by id order by pos)"))
    place = runs.withColumn("place", F.expr("row_number() over (partition by id, ok, run order by pos)"))
    merged = place.withColumn("starts", F.col("ok") & (F.col("place") % 2 == 1))
    kept = merged.withColumn("inside", F.expr("lag(starts, 1, false) over (partition by id order by pos)")).filter("not inside")
    return kept.select("id", (F.expr("row_number() over (partition by id order by pos)") - 1).cast("int").alias("pos"), F.when(F.col("starts"), F.col("new_id")).otherwise(F.col("tok")).alias("tok"))


def merge_arrays(arrays: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, tokens) after the pass of `merge_apply`, array by array and without a shuffle; empty sequences stay.

    The rules go to every executor: at most one for each pair of the vocabulary, and checked.
    """
    if rules.limit(RULES + 1).count() > RULES:
        raise ValueError("too many rules for every executor: choose a max_merges")
    table = {(r["a"], r["b"]): r["new_id"] for r in rules.select("a", "b", "new_id").collect()}
    held = arrays.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, sizes = bags.merged(*bags.flat(b.column(1)), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), bags.lists(tokens, sizes)], names=["id", "tokens"])

    return arrays.select("id", "tokens").mapInArrow(run, arrays.select("id", "tokens").schema)


def merge_diagnostics(arrays: DataFrame, rules: DataFrame, tau_pmi: float = TAU_PMI, tau_idf: float = TAU_IDF) -> DataFrame:
    """One row: thresholds, number of rules, and the vocabulary with the new tokens."""
    vocabulary = arrays.select(F.explode(F.array_distinct("tokens")).alias("tok")).agg(F.count_distinct("tok").alias("v"))
    return rules.agg(F.count("*").alias("n_merges")).select(F.lit(tau_pmi).alias("tau_pmi"), F.lit(tau_idf).alias("tau_idf"), "n_merges", (vocabulary.scalar() + F.col("n_merges")).alias("vocabulary"))
