"""Similarity joins of a stated query set against all documents, and rankings.

Scores meet on shared features: query vectors joined to document vectors, then
summed by (query, document).  Ranks are over rounded scores with the id as the
second key, so equal documents keep one order in every plan.  Only documents
that share a feature are scored; the others are added where a full ranking is
asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 9


def dots(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, cos) of vectors that share a feature, rounded."""
    q = queries.select(F.col("id").alias("query_id"), "n", "a", "b", F.col("w").alias("wq"))
    d = docs.select(F.col("id").alias("doc_id"), "n", "a", "b", F.col("w").alias("wd"))
    return d.join(q, ["n", "a", "b"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("wq") * F.col("wd")), PLACES).alias("cos"))


def every_pair(query_ids: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(query_id, doc_id): a stated query set against all documents, for full rankings only."""
    return doc_ids.select(F.col("id").alias("doc_id")).join(query_ids.select(F.col("id").alias("query_id")))


def cosine_all(query_ids: DataFrame, doc_ids: DataFrame, scored: DataFrame) -> DataFrame:
    """(query_id, doc_id, cos, rank): the full ranking of every query."""
    full = every_pair(query_ids, doc_ids).join(scored, ["query_id", "doc_id"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))
    return full.withColumn("rank", F.expr("row_number() over (partition by query_id order by cos desc, doc_id)").cast("long"))


def norms(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, norm): 1 for ids that have a vector, 0 for the others."""
    return ids.select("id").join(vectors.select("id").distinct().withColumn("norm", F.lit(1.0)), "id", "left").select("id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def knn(query_ids: DataFrame, doc_ids: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, dist, rank): the k nearest by Euclidean distance; dist is half its square.

    Half the squared distance is (|q| + |d|) / 2 - cos for norms of 0 or 1: a
    document without a vector is nearer than one of cosine below a half, and a
    query without one is at 0 from all such documents.  k may exceed N.
    """
    nq, nd = norms(query_ids, query_vectors), norms(doc_ids, doc_vectors)
    pairs = every_pair(query_ids, doc_ids).join(dots(query_vectors, doc_vectors), ["query_id", "doc_id"], "left")
    pairs = pairs.join(nq.select(F.col("id").alias("query_id"), F.col("norm").alias("nq")), "query_id").join(nd.select(F.col("id").alias("doc_id"), F.col("norm").alias("nd")), "doc_id")
    dist = F.round((F.col("nq") + F.col("nd")) / 2 - F.coalesce("cos", F.lit(0.0)), PLACES)
    ranked = pairs.select("query_id", "doc_id", dist.alias("dist")).withColumn("rank", F.expr("row_number() over (partition by query_id order by dist, doc_id)").cast("long"))
    return ranked.filter(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int, score: str = "cos") -> DataFrame:
    """The k best of each query; ranks are limited within partitions before the shuffle."""
    return scored.withColumn("rank", F.expr(f"row_number() over (partition by query_id order by {score} desc, doc_id)").cast("long")).filter(F.col("rank") <= k)


def inverted_index(arrays: DataFrame) -> DataFrame:
    """(n, a, b, doc_id, cnt): postings of tokens and bigrams."""
    from .vectorize import term_counts

    return term_counts(arrays, True).select("n", "a", "b", F.col("id").alias("doc_id"), "cnt")


def bigram_match(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of documents that a query's bigrams match, else its tokens.

    A score sums, over the query's bigrams as often as they occur, the
    document's count over the number of the query's bigrams.  Tokens serve only
    where no document has any of the bigrams.
    """
    from .vectorize import term_counts

    terms = term_counts(queries, True).select(F.col("id").alias("query_id"), "n", "a", "b", F.col("cnt").alias("times"), "parts")
    hits = index.join(terms, ["n", "a", "b"]).groupBy("n", "query_id", "doc_id").agg(F.round(F.sum(F.col("cnt") * F.col("times")) / F.max("parts"), PLACES).alias("score"))
    two = hits.filter("n = 2").select("query_id", "doc_id", "score")
    one = hits.filter("n = 1").select("query_id", "doc_id", "score").join(two.select("query_id").distinct(), "query_id", "left_anti")
    return two.union(one)


def all_after(scored: DataFrame, query_ids: DataFrame, doc_ids: DataFrame, score: str = "score") -> DataFrame:
    """(query_id, doc_id, score, rank): the matched by score, then the others in their order."""
    full = every_pair(query_ids, doc_ids).join(scored.select("query_id", "doc_id", score), ["query_id", "doc_id"], "left")
    order = F.expr(f"row_number() over (partition by query_id order by {score} is null, {score} desc, doc_id)")
    return full.withColumn("rank", order.cast("long"))


def remainder(full: DataFrame, reranked: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): reranked candidates (query_id, doc_id, sw) first, ties by cosine rank, then the others by it.

    full: (query_id, doc_id, rank) by cosine.  One sort key does it: no set
    difference is taken.
    """
    x = full.select("query_id", "doc_id", F.col("rank").alias("cos_rank")).join(reranked.select("query_id", "doc_id", "sw"), ["query_id", "doc_id"], "left")
    order = F.expr("row_number() over (partition by query_id order by sw is null, sw desc, cos_rank)")
    return x.select("query_id", "doc_id", order.cast("long").alias("rank"))


def dense_cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, cos): of pooled vectors (id, vector), each divided by its norm + 1e-8."""
    unit = lambda x, k: x.select(F.col("id").alias(k), F.transform("vector", lambda v: v / (F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y)) + 1e-8)).alias(f"v_{k}"))
    dot = F.aggregate(F.zip_with("v_query_id", "v_doc_id", lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
    return unit(docs, "doc_id").join(unit(queries, "query_id")).select("query_id", "doc_id", F.round(dot, PLACES).alias("cos"))


def cosine_pair(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """pairs with cos of two vector columns, 0 where a norm is 0."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(square(F.col(x))) * F.sqrt(square(F.col(y)))
    return pairs.withColumn("cos", F.when(norm > 0, F.round(dot / norm, PLACES)).otherwise(0.0))
