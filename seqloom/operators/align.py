"""Alignment of candidate pairs, and what is ranked by it.

Pairs reach Python as Arrow batches, only after the candidates were cut to K
for each query.  A batch is worked off query by query against padded documents
(see `seqloom.functions.kernels`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

MATCH, MISMATCH, GAP = 2.0, -1.0, 2.0
SOFT_PLACES = 4
PAIR_LIMIT = 1 << 20  # pairs that go to every executor
QUERY_LIMIT = 64 << 20  # bytes of queries, or entries of a lookup table, that go to every executor at once


def pair_tokens(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs with q and d, the token arrays of both sides, dealt by query.

    Pairs that are few enough go to the documents, so that only documents of
    pairs are shuffled.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("tokens").alias("q"))
    d = docs.select(F.col("id").alias("doc_id"), F.col("tokens").alias("d"))
    if pairs.limit(PAIR_LIMIT + 1).count() <= PAIR_LIMIT:
        pairs = d.join(F.broadcast(pairs), "doc_id").select(*pairs.columns, "d")
    else:
        pairs = pairs.join(d, "doc_id")
    return pairs.join(q, "query_id").select(*[c for c in pairs.columns if c != "d"], "q", "d").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "query_id")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def scored(pairs: DataFrame, kernel: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], name: str = "sw") -> DataFrame:
    """(query_id, doc_id, name) of pairs with q and d."""
    kind = pairs.select("query_id", "doc_id").schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, d = _arrays(b.column(2)), _arrays(b.column(3))
            out, groups = np.zeros(len(q)), {}
            for i, x in enumerate(q):
                groups.setdefault(x.tobytes(), []).append(i)
            for rows in groups.values():
                out[rows] = kernel(q[rows[0]], [d[i] for i in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["query_id", "doc_id", name])

    return pairs.select("query_id", "doc_id", "q", "d").mapInArrow(run, kind)


def sw_hard(pairs: DataFrame, match: float = MATCH, mismatch: float = MISMATCH, gap: float = GAP) -> DataFrame:
    return scored(pairs, lambda q, d: kernels.smith_waterman(q, d, match, mismatch, gap))


def sw_norm(pairs: DataFrame) -> DataFrame:
    """sw_hard over the query's length; 0 for an empty query."""
    sizes = pairs.select("query_id", "doc_id", F.size("q").alias("m"))
    return sw_hard(pairs).join(sizes, ["query_id", "doc_id"]).select("query_id", "doc_id", F.when(F.col("m") > 0, F.round(F.col("sw") / F.col("m"), 6)).otherwise(0.0).alias("sw"))


def lookup_table(lookup: DataFrame) -> dict[int, dict[int, float]]:
    """(x, y, s) as nested dicts, for the kernels: at most one entry for each ordered pair of the vocabulary, and checked."""
    n = lookup.limit(QUERY_LIMIT // 32 + 1).count()
    if n > QUERY_LIMIT // 32:
        raise ValueError("the lookup table is too large for every executor: choose a higher min_count")
    out: dict[int, dict[int, float]] = {}
    for x, y, s in lookup.select("x", "y", "s").collect():
        out.setdefault(x, {})[y] = s
    return out


def sw_soft(pairs: DataFrame, lookup: DataFrame, scale: float = 1.0) -> DataFrame:
    """Unequal tokens gain what the lookup has for them; scores are rounded so that equal ones tie."""
    table = pairs.sparkSession.sparkContext.broadcast(lookup_table(lookup))
    out = scored(pairs, lambda q, d: kernels.smith_waterman_soft(q, d, table.value, MATCH, MISMATCH, GAP, scale))
    return out.withColumn("sw", F.round("sw", SOFT_PLACES))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, doc_id, sw, rank): by score, ties by the candidates' own rank."""
    x = candidates.select("query_id", "doc_id", F.col("rank").alias("cos_rank")).join(scores, ["query_id", "doc_id"])
    return x.select("query_id", "doc_id", "sw", F.expr("row_number() over (partition by query_id order by sw desc, cos_rank)").cast("long").alias("rank"))


def regime_gate(queries: DataFrame, docs: DataFrame, limit: float = 0.15, gate: bool = True) -> DataFrame:
    """(query_id, rho, hard): whether a query's length over the documents' mean length is below the limit, or the gate is off."""
    mean = docs.agg(F.avg(F.size("tokens")).alias("m")).scalar()
    rho = F.size("tokens") / mean
    return queries.select(F.col("id").alias("query_id"), F.round(rho, 9).alias("rho")).withColumn("hard", (F.col("rho") < limit) if gate else F.lit(True))


def gated(pairs: DataFrame, gate: DataFrame, lookup: DataFrame, scale: float = 1.0) -> DataFrame:
    """Hard scores of queries that pass the gate, soft ones of the others: each kernel sees its own rows alone."""
    hard = pairs.join(gate.filter("hard").select("query_id"), "query_id", "left_semi")
    soft = pairs.join(gate.filter("not hard").select("query_id"), "query_id", "left_semi")
    return sw_hard(hard).union(sw_soft(soft, lookup, scale))


def dtw_all(queries: DataFrame, docs: DataFrame, window: int | None = None) -> DataFrame:
    """(query_id, doc_id, dist): a stated query set against every document.

    Documents are dealt evenly first, as one file may hold them all; the queries
    go to every executor in blocks of a checked size.
    """
    spark = docs.sparkSession
    docs = docs.select("id", "tokens").repartition(4 * spark.sparkContext.defaultParallelism)
    sized = queries.select("id", "tokens", F.ceil(F.expr("sum(8 * size(tokens) + 64) over (order by id)") / QUERY_LIMIT).alias("block"))
    blocks = [r["block"] for r in sized.select("block").distinct().collect()]
    out = None
    for block in sorted(blocks):
        held = spark.sparkContext.broadcast([(r["id"], np.array(r["tokens"], np.int64)) for r in sized.filter(F.col("block") == block).orderBy("id").collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _arrays(b.column(1))
                for (name, _), dist in zip(held.value, kernels.dtw_many([q for _, q in held.value], d, window), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(d), queries_type), b.column(0), pa.array(dist)], names=["query_id", "doc_id", "dist"])

        queries_type = pa.int64() if dict(queries.dtypes)["id"] == "bigint" else pa.string()
        kind = f"query_id {dict(queries.dtypes)['id']}, doc_id {dict(docs.dtypes)['id']}, dist double"
        part = docs.select("id", "tokens").mapInArrow(run, kind)
        out = part if out is None else out.union(part)
    return out.withColumn("dist", F.round("dist", 9))
