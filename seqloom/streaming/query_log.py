"""A stream of queries against a static index of document vectors.

The join of a micro-batch to the index is a stream-static join: each batch is
vectorised with the corpus vocabulary, scored, and its best documents are
appended to a table.  Batches that are run again after a failure write the same
folder, so an answer stands once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve, vectorize
from ..sources import readers
from ..sources.shared import fresh


def answer(batch: DataFrame, vocabulary: DataFrame, vectors: DataFrame, k: int, with_bigrams: bool = False) -> DataFrame:
    """(query_id, doc_id, cos, rank) of the queries (id, tokens) of one batch."""
    scored = retrieve.dots(vectorize.tfidf(batch, vocabulary, with_bigrams), vectors)
    return retrieve.top_k(scored, k)


def start(stream: DataFrame, vocabulary: DataFrame, vectors: DataFrame, k: int, into: str, checkpoint: str, with_bigrams: bool = False):
    """Answers a stream of (id, tokens); returns the running query."""

    def one(batch: DataFrame, number: int) -> None:
        answer(batch, vocabulary, vectors, k, with_bigrams).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_files(spark: SparkSession, texts: DataFrame, id_col: str, vocabulary: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Writes texts as files of a log, streams them two files at a time, and returns all answers."""
    log, into, checkpoint = (fresh(spark, n) for n in ("query-log", "answers", "stream"))
    texts.select(F.col(id_col).alias("id"), "text").repartition(4, "id").write.parquet(log)
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 2).parquet(log)
    running = start(readers.text_tokens(stream, "id"), vocabulary, vectors, k, into, checkpoint)
    running.awaitTermination()
    return spark.read.parquet(into).select("query_id", "doc_id", "cos", "rank")
