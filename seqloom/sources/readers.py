"""Readers of token tables, relevance maps, term lists, time marks and transcripts.

Token sequences are held in two forms: arrays ``(id, tokens array<bigint>)`` for
alignment, and long rows ``(id, pos, tok)`` for statistics.  `explode_tokens`
and `collect_tokens` go from one to the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import bags
from .shared import modest

#: Headers that name the id and the data column, in lower case.
ID_HEADERS = ("filename", "file", "name", "id", "stem")
DATA_HEADERS = ("data", "tokens", "token", "sequence")
WORDS = 1 << 18  # words whose ids a task remembers


@dataclass(frozen=True)
class Dialect:
    """How a token CSV is read.

    json: data may be a JSON list.  strict: items that aren't integers make the
    row's item null instead of being skipped.  keep_empty: rows without tokens
    stay.  by_position: the first two columns are meant, whatever their names.
    """

    json: bool = False
    strict: bool = False
    keep_empty: bool = False
    by_position: bool = False


MAIN = Dialect()
SWEEP = Dialect(json=True, keep_empty=True)
CROSS_LINGUAL = Dialect(json=True, keep_empty=True)
SIGNIFICANCE = Dialect(by_position=True, keep_empty=True)
BASELINE = Dialect(strict=True)
DIALECTS = {"main": MAIN, "sweep": SWEEP, "cross_lingual": CROSS_LINGUAL, "significance": SIGNIFICANCE, "baseline": BASELINE}


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def token_array(data: Column, dialect: Dialect = MAIN) -> Column:
    """Token ids of a comma list, or of a JSON list where the dialect has it."""
    plain = F.regexp_replace(F.trim(data), r"^\[|\]$", "") if dialect.json else data
    items = F.transform(F.split(plain, ","), lambda x: F.trim(x))
    if not dialect.strict:
        items = F.filter(items, lambda x: x.rlike(r"^-*[0-9]+$"))
    else:
        items = F.filter(items, lambda x: x != "")
    return F.transform(items, lambda x: x.try_cast("bigint"))


def read_token_csv(spark: SparkSession, path: str, dialect: Dialect = MAIN) -> DataFrame:
    """(id, tokens) of a CSV with a header; of rows with one id the last in the file stands.

    The order of rows is that within a file; ids that several files have take
    the last file's, by name.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    lower = {c.lower(): c for c in raw.columns}
    if dialect.by_position:
        id_col, data_col = raw.columns[0], raw.columns[1]
    else:
        id_col = next((lower[h] for h in ID_HEADERS if h in lower), raw.columns[0])
        data_col = next((lower[h] for h in DATA_HEADERS if h in lower), raw.columns[1])
    rows = raw.select(stem(F.col(f"`{id_col}`")).alias("id"), token_array(F.coalesce(F.col(f"`{data_col}`"), F.lit("")), dialect).alias("tokens"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"))
    rows = rows.filter("id is not null and id <> ''")
    if not dialect.keep_empty:
        rows = rows.filter(F.size("tokens") > 0)
    return rows.groupBy("id").agg(F.max_by("tokens", F.struct("file", "ord")).alias("tokens"))


def read_relevance(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id), distinct, of a JSON map from query ids to lists of document ids.

    A query with an empty list has a row with a null doc_id, so that the metric
    dialects can tell it from one that is missing.
    """
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query_id", "docs"))
    return pairs.select("query_id", F.explode_outer("docs").alias("doc_id")).distinct()


def resolve_ground_truth(query_ids: DataFrame, doc_ids: DataFrame, relevance: DataFrame) -> DataFrame:
    """(query_id, doc_id, key) for queries that a key of relevance names.

    A key with documents is a query's if it equals its id; else if its last part
    after ``_`` does (of several, the last by name).  Documents that the corpus
    lacks are dropped.
    """
    keyed = relevance.filter("doc_id is not null").select(F.col("query_id").alias("key"), "doc_id")
    keys = keyed.select("key").distinct()
    exact = query_ids.join(keys, query_ids["query_id"] == F.col("key"), "left_semi")
    named = exact.select("query_id", F.col("query_id").alias("key"))
    last = keys.select(F.substring_index("key", "_", -1).alias("query_id"), "key").groupBy("query_id").agg(F.max("key").alias("key"))
    named = named.union(query_ids.join(exact, "query_id", "left_anti").join(last, "query_id").select("query_id", "key"))
    return named.join(keyed, "key").join(doc_ids, "doc_id", "left_semi").select("query_id", "doc_id", "key")


def read_ecf(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the excerpts of an XML list."""
    rows = spark.read.format("xml").option("rowTag", "excerpt").schema("_audio_filename string").load(path)
    return rows.select(stem(F.col("_audio_filename")).alias("doc_id"))


def read_tlist(spark: SparkSession, path: str) -> DataFrame:
    """(query_id) of the terms of an XML list."""
    rows = spark.read.format("xml").option("rowTag", "term").schema("_termid string").load(path)
    return rows.select(F.col("_termid").alias("query_id"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of the LEXEME lines with six columns or more; repeated ones stay."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.filter((F.size("p") >= 6) & (F.col("p")[0] == "LEXEME")).select(F.col("p")[5].alias("query_id"), F.col("p")[1].alias("doc_id"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, speaker, transcript) of ``*.trans.txt`` files, whose folders are speaker/chapter; a line of an id alone has an empty transcript."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(path)
    speaker = F.element_at(F.split(F.input_file_name(), "/"), -3)
    words = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(words[0].alias("utt_id"), speaker.alias("speaker"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("transcript")).filter("utt_id <> ''")


def explode_tokens(arrays: DataFrame) -> DataFrame:
    """(id, pos, tok) of (id, tokens); empty sequences have no rows."""
    return arrays.select("id", F.posexplode("tokens").alias("pos", "tok"))


def collect_tokens(tokens: DataFrame) -> DataFrame:
    """(id, tokens) of (id, pos, tok)."""
    items = F.array_sort(F.collect_list(F.struct("pos", "tok")))
    return tokens.groupBy("id").agg(F.transform(items, lambda x: x["tok"]).alias("tokens"))


def text_tokens(texts: DataFrame, id_col: str, vocabulary: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, tokens, ...) of texts: words of letters, each put on one of ``vocabulary`` ids by its md5; further columns to keep stay.

    The stand-in for cluster ids of speech frames: any (id, tokens) will do.
    Arrow cuts the texts; a word is hashed once for each batch, not wherever it occurs.
    """
    modest(texts.sparkSession)
    words = texts.select(F.col(id_col).alias("id"), *keep, F.coalesce(F.lower("text"), F.lit("")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            column = pc.split_pattern(pc.replace_substring_regex(b.column(b.num_columns - 1), r"[^\pL]+", " "), " ")
            coded = column.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            table = np.array([known.get(w, -2) for w in names], np.int64)
            for i in np.flatnonzero(table == -2):
                # an empty word is none
                known[names[i]] = table[i] = int.from_bytes(hashlib.md5(names[i].encode()).digest()[:4]) % vocabulary if names[i] else -1
            if len(known) > WORDS:
                known.clear()
            tokens = table[coded.indices.to_numpy()]
            some = tokens >= 0
            sizes = np.bincount(bags.owners(np.diff(column.offsets.to_numpy()))[some], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], bags.lists(tokens[some], sizes)], names=b.schema.names)

    return words.mapInArrow(run, StructType([*words.schema.fields[:-1], StructField("tokens", ArrayType(LongType()))]))
