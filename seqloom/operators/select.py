"""Choice of bigram features, and filters of queries and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_pmi(values: DataFrame, tau: float, strict: bool = False) -> DataFrame:
    """Bigrams (a, b, cnt, pmi) at or, if strict, above the threshold."""
    return values.filter(F.col("pmi") > tau if strict else F.col("pmi") >= tau)


def by_frequency(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent; of equals the larger (a, b)."""
    return counts.orderBy(F.desc("cnt"), F.desc("a"), F.desc("b")).limit(n)


def at_random(counts: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the observed bigrams without replacement, the same for a seed however rows are dealt."""
    rank = F.md5(F.concat_ws("_", "a", "b", F.lit(seed)))
    return counts.orderBy(rank, "a", "b").limit(n)


def everything(counts: DataFrame) -> DataFrame:
    return counts


def nothing(counts: DataFrame) -> DataFrame:
    """No bigrams: unigrams decide."""
    return counts.filter("false")


def with_relevance(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """Queries (id, ...) that have a relevant document."""
    return queries.join(relevance.filter("doc_id is not null").select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")


def of_languages(rows: DataFrame, languages: list[str]) -> DataFrame:
    return rows.filter(F.col("lang").isin(languages))


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    """The first n queries by id."""
    return queries.orderBy("id").limit(n)
