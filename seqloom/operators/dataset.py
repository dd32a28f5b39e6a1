"""Query sets, corpora and relevance from utterances (utt_id, speaker, transcript, duration)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _draw(column: str, seed: int):
    """The order of a seeded draw without replacement, the same however rows are dealt."""
    return F.md5(F.concat_ws("_", column, F.lit(str(seed))))


def words_of(text):
    """Upper-case words of A-Z."""
    return F.filter(F.split(F.regexp_replace(F.upper(text), "[^A-Z ]", ""), " +"), lambda w: w != "")


def utterance_queries(utts: DataFrame, n_speakers: int, least: int = 3, seed: int = 42) -> DataFrame:
    """(query_id, utt_id, speaker): of each drawn speaker with enough utterances, the middle one by number of words (ties: id)."""
    counts = utts.groupBy("speaker").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    drawn = counts.orderBy(_draw("speaker", seed), "speaker").limit(n_speakers)
    sized = utts.join(drawn, "speaker").withColumn("size", F.size(F.filter(F.split("transcript", r"\s+"), lambda w: w != "")))
    placed = sized.withColumn("place", F.expr("row_number() over (partition by speaker order by size, utt_id)") - 1)
    return placed.filter("place = n div 2").select(F.concat_ws("_", F.lit("q"), "utt_id").alias("query_id"), "utt_id", "speaker")


def corpus_minus_queries(utts: DataFrame, queries: DataFrame) -> DataFrame:
    """Utterances that are no query."""
    return utts.join(queries.select("utt_id"), "utt_id", "left_anti")


def speaker_relevance(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id): corpus utterances of the query's speaker."""
    return queries.select("query_id", "speaker").join(corpus.select("speaker", F.col("utt_id").alias("doc_id")), "speaker").select("query_id", "doc_id")


def word_index(utts: DataFrame) -> DataFrame:
    """(word, utt_id): distinct words of every utterance."""
    return utts.select(F.explode(F.array_distinct(words_of(F.col("transcript")))).alias("word"), "utt_id")


def uniform_align(utts: DataFrame) -> DataFrame:
    """(utt_id, pos, word, start, end): each word has an equal part of the duration; times to 6 places, halves up."""
    words = utts.select("utt_id", "duration", words_of(F.col("transcript")).alias("w"))
    each = words.select("utt_id", (F.col("duration") / F.size("w")).alias("part"), F.posexplode("w").alias("pos", "word"))
    return each.select("utt_id", "pos", "word", F.round(F.col("pos") * F.col("part") + 1e-9, 6).alias("start"), F.round((F.col("pos") + 1) * F.col("part") + 1e-9, 6).alias("end"))


def word_queries(utts: DataFrame, n_words: int = 200, least: int = 10, per_word: int = 10, shortest: float = 0.15, longest: float = 1.5, seed: int = 42) -> DataFrame:
    """(query_id, word, source_utt, start, end): for drawn words that enough utterances have, the first aligned
    occurrence of a fitting length in the first of at most per_word drawn utterances that has one."""
    index = word_index(utts)
    common = index.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    drawn = common.orderBy(_draw("word", seed), "word").limit(n_words)
    some = index.join(drawn, "word").withColumn("key", F.md5(F.concat_ws("_", "word", "utt_id", F.lit(str(seed)))))
    some = some.withColumn("place", F.expr("row_number() over (partition by word order by key, utt_id)")).filter(F.col("place") <= per_word)
    spans = uniform_align(utts).filter((F.col("end") - F.col("start") >= shortest) & (F.col("end") - F.col("start") <= longest))
    hits = some.select("word", "utt_id", "place").join(spans, ["word", "utt_id"])
    first = hits.withColumn("k", F.expr("row_number() over (partition by word order by place, pos)")).filter("k = 1")
    return first.select(F.concat_ws("_", F.lit("q"), "word", "utt_id").alias("query_id"), "word", F.col("utt_id").alias("source_utt"), "start", "end")


def word_relevance(queries: DataFrame, utts: DataFrame) -> DataFrame:
    """(query_id, doc_id): all utterances with the query's word, the source too."""
    return queries.select("query_id", "word").join(word_index(utts).withColumnRenamed("utt_id", "doc_id"), "word").select("query_id", "doc_id")


def language_manifest(corpus: DataFrame, queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """(lang, n_queries, n_docs, n_pairs, n_positives, has_ground_truth) of languages that have both documents and queries.

    corpus: (lang, id); queries: (lang, id); relevance: (query_id, doc_id).
    """
    d = corpus.groupBy("lang").agg(F.count("*").alias("n_docs"))
    q = queries.groupBy("lang").agg(F.count("*").alias("n_queries"))
    inside = relevance.join(corpus.select(F.col("id").alias("doc_id"), F.col("lang").alias("doc_lang")), "doc_id")
    inside = inside.join(queries.select(F.col("id").alias("query_id"), "lang"), "query_id").filter(F.col("lang") == F.col("doc_lang"))
    r = inside.groupBy("lang").agg(F.count("*").alias("n_positives"))
    x = q.join(d, "lang").join(r, "lang", "left").withColumn("n_positives", F.coalesce("n_positives", F.lit(0)))
    return x.select("lang", "n_queries", "n_docs", (F.col("n_queries") * F.col("n_docs")).alias("n_pairs"), "n_positives", (F.col("n_positives") > 0).alias("has_ground_truth"))
