"""Sinks: token tables, relevance files, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_token_csv(arrays: DataFrame, path: str) -> None:
    """``Filename,Data`` rows of (id, tokens), the ids as a quoted comma list."""
    data = F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")
    arrays.select(F.col("id").cast("string").alias("Filename"), data.alias("Data")).write.option("header", True).option("quoteAll", True).csv(path)


def relevance_map(relevance: DataFrame) -> DataFrame:
    """(value): one JSON map of all queries and their documents, for a file that is read as a whole.

    It is one value by its format; qrels (`dense_qrels`) have no such limit.
    """
    lists = relevance.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    return lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("query_id").cast("string"), F.transform("docs", lambda d: d.cast("string"))))))).alias("value"))


def write_relevance(relevance: DataFrame, path: str) -> None:
    relevance_map(relevance).write.text(path)


def dense_qrels(queries: DataFrame, docs: DataFrame, relevance: DataFrame) -> DataFrame:
    """(query_id, iter, doc_id, relevance): each of a stated set of queries with every document, 0 or 1."""
    pairs = docs.select("doc_id").join(F.broadcast(queries.select("query_id")) if small(queries) else queries.select("query_id"))
    known = relevance.select("query_id", "doc_id", F.lit(1).alias("one")).distinct()
    return pairs.join(known, ["query_id", "doc_id"], "left").select("query_id", F.lit(0).alias("iter"), "doc_id", F.coalesce("one", F.lit(0)).alias("relevance"))


def small(queries: DataFrame, limit: int = 100_000) -> bool:
    """Whether a stated query set has few enough rows to go to every executor."""
    return queries.limit(limit + 1).count() <= limit


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.write.option("sep", "\t").option("header", True).csv(path)


def result_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with the fields of a result table: further columns are left out, missing ones are null."""
    return rows.select(*(F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields))


def write_results(rows: DataFrame, fields: list[str], path: str) -> None:
    result_rows(rows, fields).write.option("header", True).csv(path)


def ap_wide(per_query: DataFrame, systems: list[str]) -> DataFrame:
    """One row for each query with a column for each system: its average precision to 6 places, blank if missing."""
    wide = per_query.groupBy("query_id").pivot("system", systems).agg(F.first("ap"))
    return wide.select("query_id", *(F.coalesce(F.format_string("%.6f", F.col(s)), F.lit("")).alias(s) for s in systems))
