"""The queries of this subpackage, thin layers over its operators, and their SQL.

Each takes (spark, sf_dir) and runs its operator over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, line_dedup, neardup, quality, sharding, token_shards, toxicity, url_filter
from .store import keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> str:
    """The production rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.block_list(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counted = keep(quality.counts(docs, drop=("text",)), "counted")
    learned = quality.learn(counted, _table(spark, sf_dir, "labels"))
    return quality.judge(counted, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.digest(decontam.mark(docs, _table(spark, sf_dir, "benchmark"), drop=("text",)))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks())


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks(), drop=("text",)), ranks())
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.in_part(F.col("doc_id"), 3, 1))
    model = toxicity.fit(docs.filter("not held_out"), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, drop=("text",)).select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.in_part(F.col("doc_id"), 4, 2))
    found = langid.fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return langid.identify(docs.drop("lang"), found, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_quality_rules, op3_benchmark_decontamination, op4_minhash_near_dedup, op5_token_id_output, op6_byte_bpe, op7_toxicity, op8_line_dedup, op9_sharding, op10_language_id)}


_HOST_PATH = """
SELECT page_id,
       translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""


def _op1_sql() -> str:
    cases = []
    for _, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        domain, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    listed = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in url_filter.LISTED)
    listed += rf" OR coalesce(try_cast(regexp_extract(host, '(^|\.)listed-(0|[1-9][0-9]*)\.example\.org$', 2) AS BIGINT), {url_filter.MORE}) < {url_filter.MORE}"
    actions = " ".join(f"WHEN rule = '{r}' THEN '{a}'" for a, r in url_filter.RULES)
    return f"""
SELECT page_id, host, path, rule, CASE {actions} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM (SELECT page_id, host, path, CASE {" ".join(cases)} END AS rule, ({listed}) AS listed FROM ({_HOST_PATH}))
"""


def _op2_sql() -> str:
    rules = list(quality.RATES.items())
    rates = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, least({quality.LEVELS}, ({quality.LEVELS} * {a}) // greatest({b}, 1)) AS lvl FROM base WHERE NOT base_failed" for r, (a, b) in rules)
    risk, size = quality.ALPHA / len(rules), f"({quality.DELTA} / ({len(rules)} * (SELECT count(DISTINCT stratum) FROM sizes)))"
    pvalue = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM again) GROUP BY rid),
counted AS (SELECT w.doc_id, w.stratum, w.rid, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_caps, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks
  FROM w LEFT JOIN rep USING (rid)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM counted),
rated AS ({rates}),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
each AS (SELECT doc_id, stratum, rule, max(lvl) AS lvl, any_value(quality) AS quality FROM rated JOIN known USING (doc_id) GROUP BY doc_id, stratum, rule),
sizes AS (SELECT stratum, rule, lvl, sum(quality) AS g, sum(1 - quality) AS b FROM each GROUP BY ALL),
grid AS (SELECT stratum, rule, l AS cut FROM (SELECT DISTINCT stratum, rule FROM sizes), range(1, {quality.LEVELS + 1}) r(l)),
tried AS (SELECT g.stratum, g.rule, g.cut, coalesce(sum(s.g) FILTER (s.lvl >= g.cut), 0)::BIGINT AS k, coalesce(sum(s.b) FILTER (s.lvl >= g.cut), 0)::BIGINT AS won, sum(s.g)::BIGINT AS n
  FROM grid g JOIN sizes s USING (stratum, rule) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN n = 0 OR k >= {risk} * n THEN false ELSE {pvalue} <= {size} END AS ok FROM tried),
valid AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS allowed FROM tested),
best AS (SELECT stratum, rule, cut FROM valid WHERE allowed AND won > k QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY won - k DESC, cut DESC) = 1),
hit AS (SELECT DISTINCT b.rid FROM base b JOIN best USING (stratum)
  WHERE {" OR ".join(f"(rule = '{r}' AND least({quality.LEVELS}, ({quality.LEVELS} * {a}) // greatest({b}, 1)) >= cut)" for r, (a, b) in rules)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM hit) AS kept FROM base
"""


def _op3_sql() -> str:
    split = r"list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {split.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {split.format("coalesce(text, '')")} AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS l, array_to_string(w[i:i + least(len(w), {decontam.WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontam.WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM s) WHERE len(w) >= l)),
f AS (SELECT rid, i, l, item_id FROM p JOIN s USING (l, g)),
h AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + l)) AS j FROM f) GROUP BY rid),
n AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _op1_sql(), "op2_quality_rules": _op2_sql(), "op3_benchmark_decontamination": _op3_sql()}
