"""Ranking metrics.

Queries enter an average by one of the `Dialect`s: whether one that the
relevance table lacks, or that has an empty list there, counts with 0 or not at
all, and whether relevant documents outside the corpus count as missed.
Only relevant rows of a ranking are looked at, so its size doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10)


@dataclass(frozen=True)
class Dialect:
    include_missing: bool
    include_empty: bool
    restrict_to_corpus: bool


CORE = Dialect(True, True, True)
SWEEP = Dialect(False, True, False)
STRICT = Dialect(False, False, False)
BUILDER = Dialect(True, True, False)
DIALECTS = {"core": CORE, "sweep": SWEEP, "strict": STRICT, "builder": BUILDER}


def relevant_ranks(scored: DataFrame, relevance: DataFrame, score: str = "cos") -> DataFrame:
    """(query_id, doc_id, rank) of relevant documents alone, from scores and without a sort.

    A rank is one more than the documents before it, by score and then id:
    the relevant rows, few for each query, meet the query's scores, and only
    counts are shuffled.
    """
    own = scored.join(relevance.select("query_id", "doc_id"), ["query_id", "doc_id"]).select("query_id", F.col("doc_id").alias("rel_id"), F.col(score).alias("own"))
    before = (F.col(score) > F.col("own")) | ((F.col(score) == F.col("own")) & (F.col("doc_id") < F.col("rel_id")))
    return scored.join(own, "query_id").groupBy("query_id", F.col("rel_id").alias("doc_id")).agg((1 + F.count_if(before)).alias("rank"))


def judged_queries(query_ids: DataFrame, relevance: DataFrame, dialect: Dialect = CORE, doc_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, n_rel) of the queries that a dialect averages over."""
    rel = relevance.select("query_id", "doc_id").distinct()
    if dialect.restrict_to_corpus and doc_ids is not None:
        inside = rel.join(doc_ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        rel = inside.select("query_id", "doc_id").union(rel.select("query_id", F.lit(None).cast(dict(rel.dtypes)["doc_id"]).alias("doc_id")).distinct())
    n = rel.groupBy("query_id").agg(F.count("doc_id").alias("n_rel"))
    out = query_ids.select(F.col("id").alias("query_id")).join(n, "query_id", "left" if dialect.include_missing else "inner").select("query_id", F.coalesce("n_rel", F.lit(0)).alias("n_rel"))
    return out if dialect.include_empty else out.filter("n_rel > 0")


def per_query(ranked: DataFrame, relevance: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, n_rel, ap, rr, p1, ..., r1, ...) of judged queries (query_id, n_rel)."""
    hits = ranked.join(relevance.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    hits = hits.withColumn("hits", F.expr("row_number() over (partition by query_id order by rank)"))
    top = [F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks]
    sums = hits.groupBy("query_id").agg(F.sum(F.col("hits") / F.col("rank")).alias("s"), F.min("rank").alias("first"), *top)
    x = queries.join(sums, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        "query_id",
        "n_rel",
        zero(F.col("s") / F.nullif(F.col("n_rel"), F.lit(0))).alias("ap"),
        zero(1 / F.col("first")).alias("rr"),
        *(zero(F.col(f"h{k}") / k).alias(f"p{k}") for k in ks),
        *(zero(F.col(f"h{k}") / F.greatest("n_rel", F.lit(1))).alias(f"r{k}") for k in ks),
    )


def summary(values: DataFrame, ks: tuple[int, ...] = KS, places: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of `per_query`: map, mrr, p and r at ks, and the number of queries."""
    means = [F.round(F.avg(c), places).alias(name) for c, name in [("ap", "map"), ("rr", "mrr"), *((f"p{k}", f"p{k}") for k in ks), *((f"r{k}", f"r{k}") for k in ks)]]
    return values.groupBy(*by).agg(F.count("*").alias("n_queries"), *means)


def gain(new, old):
    """Relative gain of a metric."""
    return (new - old) / F.greatest(old, F.lit(1e-9))


def mtwv(scored: DataFrame, relevance: DataFrame, steps: int = 300, score: str = "cos") -> DataFrame:
    """(query_id, mtwv): the best of 1 - (P_miss + beta P_fa) over thresholds from the least score to the largest.

    beta is the false over the true documents; a query without true ones has 0.
    Scores are put on the grid first, so a threshold's counts are running sums
    over at most ``steps`` rows of each query, however many documents there are.
    """
    rel = relevance.select("query_id", "doc_id", F.lit(1).alias("true")).distinct()
    x = scored.select("query_id", "doc_id", F.col(score).alias("s")).join(rel, ["query_id", "doc_id"], "left").withColumn("true", F.coalesce("true", F.lit(0)))
    span = x.groupBy("query_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("true").alias("n_true"), F.count("*").alias("n"))
    # the last threshold of linspace(lo, hi, steps) at or below the score accepts it
    at = F.when(F.col("hi") > F.col("lo"), F.floor(F.round((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (steps - 1), 9))).otherwise(steps - 1)
    cells = x.join(span, "query_id").select("query_id", at.cast("int").alias("step"), "true").groupBy("query_id", "step").agg(F.sum("true").alias("t"), F.sum(1 - F.col("true")).alias("f"))
    grid = span.select("query_id", "n_true", (F.col("n") - F.col("n_true")).alias("n_false"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    run = grid.join(cells, ["query_id", "step"], "left").withColumns({c: F.expr(f"sum(coalesce({c}, 0)) over (partition by query_id order by step desc)") for c in ("t", "f")})
    beta = F.when(F.col("n_true") > 0, F.col("n_false") / F.col("n_true")).otherwise(0.0)
    miss = 1 - F.col("t") / F.nullif(F.col("n_true"), F.lit(0))
    false_alarm = F.when(F.col("n_false") > 0, F.col("f") / F.col("n_false")).otherwise(0.0)
    return run.groupBy("query_id").agg(F.round(F.coalesce(F.max(1 - (miss + beta * false_alarm)), F.lit(0.0)), 6).alias("mtwv"))


def best_config(rows: DataFrame, by: str | None = None, score: str = "map", name: str = "config") -> DataFrame:
    """The row of the best score, of each group if one is named (ties: the first by name)."""
    keys = [by] if by else []
    part = f"partition by {by} " if by else ""
    return rows.withColumn("place", F.expr(f"row_number() over ({part}order by {score} desc, {name})")).filter("place = 1").select(*keys, name, score)
