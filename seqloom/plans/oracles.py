"""DuckDB SQL for the queries of `seqloom.plans.catalog`, written apart from them.

`PRELUDE` holds the views that all share; a query's own part is appended.
Queries without SQL here are tested against brute force.
"""

from __future__ import annotations

from .catalog import LANGUAGES, N_CHOSEN, TAU

_TOKENS = r"list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}]+'), lambda x: x <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {1})"
_LANGS = "[" + ", ".join(f"'{x}'" for x in LANGUAGES) + "]"

PRELUDE = rf"""
WITH docs AS MATERIALIZED (SELECT doc_id AS id, lang, {_TOKENS.format("text", 100)} AS tokens FROM documents),
qs AS MATERIALIZED (SELECT item_id AS id, {_LANGS}[item_id % {len(LANGUAGES)} + 1] AS lang, {_TOKENS.format("text", 100)} AS tokens FROM benchmark),
dt AS (SELECT id, i - 1 AS pos, tokens[i] AS tok FROM (SELECT id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM docs)),
qt AS (SELECT id, i - 1 AS pos, tokens[i] AS tok FROM (SELECT id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM qs)),
db AS MATERIALIZED (SELECT id, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM docs)),
qb AS (SELECT id, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM qs)),
rel AS MATERIALIZED (SELECT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
uni AS MATERIALIZED (SELECT tok, count(*) AS cf, count(DISTINCT id) AS df FROM dt GROUP BY tok),
big AS MATERIALIZED (SELECT a, b, count(*) AS cnt, count(DISTINCT id) AS df FROM db GROUP BY a, b),
n AS (SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT sum(cf) FROM uni) AS n_tok, (SELECT sum(cnt) FROM big) AS n_bi),
pm AS MATERIALIZED (SELECT a, b, cnt, round(ln((cnt / n_bi) / ((x.cf / n_tok) * (y.cf / n_tok))), 12) AS pmi, greatest(ln(n_docs / x.df), ln(n_docs / y.df)) AS max_idf
  FROM big JOIN uni x ON x.tok = a JOIN uni y ON y.tok = b, n),
plain AS (SELECT tok, df, ln(n_docs / df) AS idf FROM uni, n),
smooth AS (SELECT tok, df, ln(n_docs / (1 + df)) AS idf FROM uni, n)
"""


def _vector(kind: str, idf: str, chosen: str | None = None, smooth: int = 0, alpha: float = 0.5) -> str:
    """Vectors of docs ('d') or queries ('q') as (id, n, a, b, w)."""
    arrays, tokens, pairs = ("docs", "dt", "db") if kind == "d" else ("qs", "qt", "qb")
    one = f"SELECT t.id, 1 AS n, t.tok AS a, 0 AS b, count(*) / any_value(len(s.tokens)) * any_value(i.idf) AS w FROM {tokens} t JOIN {arrays} s USING (id) JOIN {idf} i USING (tok) GROUP BY t.id, t.tok"
    two = ""
    if chosen:
        two = f"UNION ALL SELECT t.id, 2, t.a, t.b, {alpha} * count(*) / any_value(len(s.tokens) - 1) * any_value(ln((SELECT n_docs FROM n) / (g.df + {smooth}))) FROM {pairs} t JOIN {arrays} s USING (id) JOIN big g ON g.a = t.a AND g.b = t.b WHERE (t.a, t.b) IN ({chosen}) GROUP BY t.id, t.a, t.b"
    return f"SELECT id, n, a, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ({one} {two}) WHERE w <> 0"


_PMI_GE = f"SELECT a, b FROM pm WHERE cnt >= 2 AND pmi >= {TAU}"
_PMI_GT = f"SELECT a, b FROM pm WHERE pmi > {TAU}"
_FREQ = f"SELECT a, b FROM big ORDER BY cnt DESC, a DESC, b DESC LIMIT {N_CHOSEN}"
_RAND = f"SELECT a, b FROM big ORDER BY md5(concat_ws('_', a, b, {{0}})), a, b LIMIT {N_CHOSEN}"


def _cos(queries: str, docs: str, s: str = "") -> str:
    """CTEs dv, qv, dot (rounded), ful (all pairs, with cos and rank), near; s is put after their names."""
    return f""",
dv{s} AS MATERIALIZED ({docs}), qv{s} AS MATERIALIZED ({queries}),
dot{s} AS MATERIALIZED (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.w * d.w), 9) AS cos FROM qv{s} q JOIN dv{s} d USING (n, a, b) GROUP BY q.id, d.id),
ful{s} AS MATERIALIZED (SELECT q.id AS query_id, d.id AS doc_id, coalesce(cos, 0) AS cos, row_number() OVER (PARTITION BY q.id ORDER BY coalesce(cos, 0) DESC, d.id) AS rank
  FROM qs q CROSS JOIN docs d LEFT JOIN dot{s} o ON o.query_id = q.id AND o.doc_id = d.id),
near{s} AS MATERIALIZED (SELECT query_id, doc_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round((q.x + d.x) / 2 - cos, 9) AS dist FROM ful{s}
  JOIN (SELECT id, (id IN (SELECT id FROM qv{s}))::INT AS x FROM qs) q ON q.id = query_id JOIN (SELECT id, (id IN (SELECT id FROM dv{s}))::INT AS x FROM docs) d ON d.id = doc_id)
  QUALIFY rank <= 50)
"""


_PLAIN = _cos(_vector("q", "plain"), _vector("d", "plain"))
_SMOOTH = _cos(_vector("q", "smooth"), _vector("d", "smooth"))


def _sw(candidates: str) -> str:
    """CTE sw (query_id, doc_id, sw): local alignment of candidate pairs, a query position at a step."""
    return f""",
cells AS MATERIALIZED (SELECT c.query_id, c.doc_id, j, d.tokens[j] AS t FROM {candidates} c JOIN docs d ON d.id = c.doc_id, unnest(range(1, len(d.tokens) + 1)) u(j)),
steps AS (
  SELECT query_id, doc_id, j, t, 0 AS i, 0 AS v FROM cells
  UNION ALL
  SELECT query_id, doc_id, j, t, i, (max(tv + 2 * j) OVER (PARTITION BY query_id, doc_id ORDER BY j) - 2 * j)::INT FROM (
    SELECT s.query_id, s.doc_id, s.j, s.t, s.i + 1 AS i,
           greatest(0, coalesce(lag(s.v) OVER (PARTITION BY s.query_id, s.doc_id ORDER BY s.j), 0) + CASE WHEN s.t = q.tokens[s.i + 1] THEN 2 ELSE -1 END, s.v - 2) AS tv
    FROM steps s JOIN qs q ON q.id = s.query_id WHERE s.i < len(q.tokens))
),
sw AS MATERIALIZED (SELECT c.query_id, c.doc_id, coalesce(max(v), 0)::DOUBLE AS sw FROM {candidates} c LEFT JOIN steps s USING (query_id, doc_id) GROUP BY ALL)
"""


_LOOKUP = """,
lk AS MATERIALIZED (SELECT coalesce(p.a, r.b) AS x, coalesce(p.b, r.a) AS y, coalesce(r.pmi, p.pmi) AS s FROM (SELECT * FROM pm WHERE cnt >= 2) p FULL JOIN (SELECT * FROM pm WHERE cnt >= 2) r ON r.a = p.b AND r.b = p.a)"""
#: `_sw` with the lookup's value for unequal tokens.
_SOFT = (
    _LOOKUP
    + _sw("near")
    .replace("THEN 2 ELSE -1 END", "THEN 2 ELSE coalesce(l.s, -1) END")
    .replace("ON q.id = s.query_id WHERE", "ON q.id = s.query_id LEFT JOIN lk l ON l.x = q.tokens[s.i + 1] AND l.y = s.t WHERE")
    .replace("0 AS i, 0 AS v FROM cells", "0 AS i, 0::DOUBLE AS v FROM cells")
    .replace("- 2 * j)::INT FROM", "- 2 * j)::DOUBLE FROM")
    .replace("coalesce(max(v), 0)::DOUBLE AS sw", "round(coalesce(max(v), 0), 4)::DOUBLE AS sw")
)


_RERANK = "SELECT query_id, doc_id, sw, row_number() OVER (PARTITION BY query_id ORDER BY sw DESC, rank) AS rank FROM sw JOIN near USING (query_id, doc_id)"
_TOP = ", top AS (SELECT query_id, doc_id, rank FROM ful WHERE rank <= 50)"
_AFTER = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sw IS NULL, sw DESC, rank) AS rank FROM ful LEFT JOIN sw USING (query_id, doc_id)"


def _per_query(s: str = "") -> str:
    """CTE pq: per-query metrics of the ranking ful; all relevant documents are in the corpus here, so dialects differ in the queries alone."""
    return f""",
hits{s} AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS h FROM ful{s} JOIN (SELECT DISTINCT * FROM rel) USING (query_id, doc_id)),
pq{s} AS MATERIALIZED (SELECT q.id AS query_id, q.lang, r.n_rel, coalesce(x / n_rel, 0) AS ap, coalesce(1 / f, 0) AS rr,
  {", ".join(f"coalesce(h{k}, 0) / {k} AS p{k}, coalesce(h{k}, 0) / greatest(n_rel, 1) AS r{k}" for k in (1, 5, 10))}
  FROM qs q JOIN (SELECT id, count(DISTINCT doc_id) AS n_rel FROM qs LEFT JOIN rel ON query_id = id GROUP BY id) r ON r.id = q.id
  LEFT JOIN (SELECT query_id, sum(h / rank) AS x, min(rank) AS f, {", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in (1, 5, 10))} FROM hits{s} GROUP BY query_id) m ON m.query_id = q.id)
"""


def _in_language(lang: str) -> str:
    """Mean metrics of the unigram cosine within a language, over its queries that have a relevant document."""
    only = PRELUDE.replace("AS tokens FROM documents)", f"AS tokens FROM documents WHERE lang = '{lang}')").replace("AS tokens FROM benchmark)", f"AS tokens FROM benchmark WHERE {_LANGS}[item_id % {len(LANGUAGES)} + 1] = '{lang}')")
    return f"({only}{_PLAIN}{_per_query()} SELECT round(avg(ap), 6) AS map, round(avg(p1), 6) AS p1 FROM pq WHERE n_rel > 0 HAVING count(*) > 0)"


_SUMMARY = "count(*) AS n_queries, round(avg(ap), 4) AS map, round(avg(rr), 4) AS mrr, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("p1", "p5", "p10", "r1", "r5", "r10"))
_RULES = f"""SELECT a, b, pmi, (SELECT max(tok) FROM uni) + row_number() OVER (ORDER BY pmi DESC, a, b) AS new_id
  FROM (SELECT a, b, pmi FROM pm WHERE cnt >= 2 AND pmi >= {TAU} AND round(max_idf, 12) <= 3.0 ORDER BY pmi DESC, a, b LIMIT 50)"""


def _merged(tokens: str) -> str:
    return f""",
rules AS MATERIALIZED ({_RULES}),
m1 AS (SELECT t.id, t.pos, t.tok, r.new_id FROM (SELECT *, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM {tokens}) t LEFT JOIN rules r ON r.a = t.tok AND r.b = t.nxt),
m2 AS (SELECT *, sum((new_id IS NULL)::INT) OVER (PARTITION BY id ORDER BY pos) AS run FROM m1),
m3 AS (SELECT *, new_id IS NOT NULL AND row_number() OVER (PARTITION BY id, run, new_id IS NOT NULL ORDER BY pos) % 2 = 1 AS starts FROM m2),
m4 AS (SELECT *, lag(starts, 1, false) OVER (PARTITION BY id ORDER BY pos) AS inside FROM m3),
mt AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, CASE WHEN starts THEN new_id ELSE tok END AS tok FROM m4 WHERE NOT inside)
"""


_BOTH = _PLAIN + _cos(_vector("q", "smooth"), _vector("d", "smooth"), "_s") + _per_query() + _per_query("_s")
_PAIRS = """, xy AS (SELECT query_id, p.lang, round(round(s.ap, 6) - round(p.ap, 6), 9) AS diff FROM pq p JOIN pq_s s USING (query_id)),
tests AS (SELECT 'all' AS lang, query_id, diff FROM xy UNION ALL SELECT lang, query_id, diff FROM xy),
ranks AS (SELECT lang, diff, rank() OVER (PARTITION BY lang ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY lang, abs(diff)) - 1) / 2 AS r FROM tests WHERE diff <> 0),
sums AS (SELECT lang, count(*) AS n_used, coalesce(sum(r) FILTER (diff > 0), 0)::DOUBLE AS wp, coalesce(sum(r) FILTER (diff < 0), 0)::DOUBLE AS wm FROM ranks GROUP BY lang)
"""


def _random(seed: int) -> str:
    return _cos(_vector("q", "smooth", _RAND.format(seed), 1), _vector("d", "smooth", _RAND.format(seed), 1), f"_{seed}") + _per_query(f"_{seed}")


_WORDS = r"list_filter(string_split_regex(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z ]', '', 'g'), ' +'), lambda w: w <> '')"
_UTTS = r"""utts AS MATERIALIZED (SELECT doc_id::VARCHAR AS utt_id, source AS speaker, text AS transcript, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"""
_UQ = f"""{_UTTS},
drawn AS (SELECT speaker, count(*) AS n FROM utts GROUP BY speaker HAVING count(*) >= 3 ORDER BY md5(concat_ws('_', speaker, '42')), speaker LIMIT 10),
uq AS (SELECT 'q_' || utt_id AS query_id, utt_id, speaker FROM (SELECT u.*, n, row_number() OVER (PARTITION BY speaker ORDER BY size, utt_id) - 1 AS k FROM utts u JOIN drawn USING (speaker)) WHERE k = n // 2)"""
_FRAMES = """fr AS MATERIALIZED (SELECT vec_id // 10 AS utt_id, vec_id % 10 AS frame_no, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
fl AS (SELECT utt_id, frame_no, label, i - 1 AS dim, e[i] AS v FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM fr)),
cen AS (SELECT label AS cluster, dim, round(avg(v), 9) AS v FROM fl GROUP BY label, dim),
asg AS (SELECT utt_id, frame_no, cluster AS tok, dist FROM (SELECT f.utt_id, f.frame_no, c.cluster, round(sqrt(sum((f.v - c.v) * (f.v - c.v))), 6) AS dist FROM fl f JOIN cen c USING (dim) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY utt_id, frame_no ORDER BY dist, cluster) = 1),
pool AS MATERIALIZED (SELECT utt_id AS id, dim, round(avg(v), 6) AS v FROM fl GROUP BY ALL)"""
_DENSE = f"""WITH {_FRAMES}, nrm AS (SELECT id, sqrt(sum(v * v)) AS nv FROM pool GROUP BY id),
dc AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum((q.v / (qn.nv + 1e-8)) * (d.v / (dn.nv + 1e-8))), 9) AS cos FROM pool q JOIN pool d USING (dim) JOIN nrm qn ON qn.id = q.id JOIN nrm dn ON dn.id = d.id WHERE q.id % 20 = 0 GROUP BY ALL)"""


_RANK = "SELECT query_id, doc_id, rank FROM ful"


def _p(sql: str, *ctes: str) -> str:
    return PRELUDE + "".join(ctes) + sql


ORACLES: dict[str, str] = {
    "scan_token_csv": _p("SELECT id, pos, tok FROM dt"),
    "sink_token_csv": _p("SELECT id::VARCHAR AS filename, array_to_string(tokens, ',') AS data FROM qs"),
    "scan_relevance": _p("SELECT DISTINCT query_id, doc_id FROM rel"),
    "resolve_ground_truth": _p("SELECT DISTINCT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, CASE WHEN query_id % 2 = 1 THEN 'q_WORD_' || query_id ELSE query_id::VARCHAR END AS key FROM rel"),
    "scan_ecf": "SELECT doc_id FROM documents",
    "scan_tlist": "SELECT 'T-' || item_id AS query_id FROM benchmark",
    "scan_rttm": _p("SELECT query_id, doc_id FROM rel, range(2)"),
    "scan_transcripts": r"SELECT doc_id AS utt_id, source AS speaker, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), ' ')) AS transcript_md5 FROM documents",
    "sink_metadata": _p("SELECT q.id AS query_id, 0 AS iter, d.id AS doc_id, ((q.id, d.id) IN (SELECT query_id, doc_id FROM rel))::INT AS relevance FROM qs q CROSS JOIN docs d"),
    "sink_results": _p("SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM qs) AS n_queries, CASE WHEN (SELECT avg(len(tokens)) FROM qs) / (SELECT avg(len(tokens)) FROM docs) < 0.15 THEN 'SW regime' ELSE 'TF-IDF regime' END AS regime, NULL::VARCHAR AS notes"),
    "all_pairs": "SELECT item_id AS query_id, doc_id FROM benchmark CROSS JOIN documents",
    "lang_manifest": _p(
        "SELECT lang, n_queries, n_docs, n_queries * n_docs AS n_pairs, coalesce(k, 0) AS n_positives, coalesce(k, 0) > 0 AS has_ground_truth FROM (SELECT lang, count(*) AS n_queries FROM qs GROUP BY lang) JOIN (SELECT lang, count(*) AS n_docs FROM docs GROUP BY lang) USING (lang) LEFT JOIN (SELECT q.lang, count(*) AS k FROM rel JOIN qs q ON q.id = query_id JOIN docs d ON d.id = doc_id AND d.lang = q.lang GROUP BY q.lang) USING (lang)"
    ),
    "doc_length": _p("SELECT id, len(tokens) AS n FROM docs WHERE len(tokens) > 0"),
    "corpus_stats": _p(
        "SELECT *, round(mq / ml, 6) AS rho, CASE WHEN mq / ml < 0.15 THEN 'SW regime' ELSE 'TF-IDF regime' END AS regime FROM (SELECT * EXCLUDE (mq, ml), mq, ml, round(ml, 6) AS mean_len, round(mq, 6) AS mean_query FROM (SELECT count(*) AS n_docs, min(len(tokens)) AS min_len, avg(len(tokens)) AS ml, max(len(tokens)) AS max_len, (SELECT count(*) FROM qs) AS n_queries, (SELECT avg(len(tokens)) FROM qs) AS mq, (SELECT count(*) FROM uni) AS vocabulary FROM docs)), (SELECT min(k) AS min_rel, round(avg(k), 6) AS mean_rel, max(k) AS max_rel FROM (SELECT q.id, count(doc_id) AS k FROM qs q LEFT JOIN rel ON query_id = q.id GROUP BY q.id))"
    ).replace("SELECT *, round(mq / ml, 6)", "SELECT * EXCLUDE (mq, ml), round(mq / ml, 6)"),
    "regime_label": _p("SELECT id AS query_id, round(round(len(tokens) / m, 9), 6) AS rho, CASE WHEN round(len(tokens) / m, 9) < 0.15 THEN 'SW regime' ELSE 'TF-IDF regime' END AS regime FROM qs, (SELECT avg(len(tokens)) AS m FROM docs)"),
    "unigram_counts": _p("SELECT tok, cf FROM uni"),
    "doc_freq": _p("SELECT tok, df FROM uni"),
    "idf_plain": _p("SELECT tok, df, round(idf, 6) AS idf FROM plain"),
    "idf_smooth": _p("SELECT tok, df, round(idf, 6) AS idf FROM smooth"),
    "bigram_counts": _p("SELECT a, b, cnt FROM big"),
    "bigram_df": _p("SELECT a, b, df FROM big"),
    "unigram_logprob": _p("SELECT tok, round(ln(cf / n_tok), 6) AS logp FROM uni, n"),
    "pmi": _p("SELECT a, b, cnt, round(pmi, 6) AS pmi FROM pm WHERE cnt >= 2"),
    "pmi_dense": _p("SELECT x.tok AS a, y.tok AS b, coalesce(cnt, 0) AS cnt, coalesce(round(pmi, 6), '-inf'::DOUBLE) AS pmi FROM uni x CROSS JOIN uni y LEFT JOIN pm ON a = x.tok AND b = y.tok"),
    "corpus_idf_gate": _p("SELECT a, b, round(max_idf, 6) AS max_idf FROM pm WHERE cnt >= 2 AND round(max_idf, 12) <= 0.35"),
    "pmi_symmetric": _p("SELECT coalesce(p.a, r.b) AS x, coalesce(p.b, r.a) AS y, round(coalesce(r.pmi, p.pmi), 6) AS s FROM (SELECT * FROM pm WHERE cnt >= 2) p FULL JOIN (SELECT * FROM pm WHERE cnt >= 2) r ON r.a = p.b AND r.b = p.a"),
    "select_pmi_ge": _p(f"SELECT a, b, cnt, round(pmi, 6) AS pmi FROM pm WHERE cnt >= 2 AND pmi >= {TAU}"),
    "select_pmi_gt": _p(f"SELECT a, b, cnt, round(pmi, 6) AS pmi FROM pm WHERE pmi > {TAU}"),
    "select_frequency": _p(f"SELECT a, b, cnt FROM big WHERE (a, b) IN ({_FREQ})"),
    "select_random": _p(f"SELECT a, b, cnt FROM big WHERE (a, b) IN ({_RAND.format(42)})"),
    "select_all": _p("SELECT x.tok AS a, y.tok AS b, coalesce(cnt, 0) AS cnt FROM uni x CROSS JOIN uni y LEFT JOIN big ON a = x.tok AND b = y.tok"),
    "select_none": _p("SELECT a, b, cnt FROM big WHERE false"),
    "eval_query_filter": _p("SELECT id FROM qs WHERE id IN (SELECT query_id FROM rel)"),
    "lang_filter": "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')",
    "limit_queries": "SELECT item_id AS id FROM benchmark ORDER BY item_id LIMIT 10",
    "tfidf_unigram": _p(f"SELECT id, n, a, b, round(w, 6) AS w FROM ({_vector('d', 'plain')})"),
    "tfidf_pmi": _p(f"SELECT id, n, a, b, round(w, 6) AS w FROM ({_vector('d', 'plain', _PMI_GE)})"),
    "tfidf_allbigrams": _p(f"SELECT id, n, a, b, round(w, 6) AS w FROM ({_vector('d', 'smooth', 'SELECT a, b FROM big', 1)})"),
    "tfidf_selected": _p(f"SELECT id, n, a, b, round(w, 6) AS w FROM ({_vector('d', 'smooth', _FREQ, 1)})"),
    "tfidf_bsd": _p(f"SELECT id, n, a, b, round(w, 6) AS w FROM ({_vector('d', 'smooth', _PMI_GT, 1)})"),
    "feature_count": _p(f"SELECT u AS n_unigrams, g AS n_bigrams, u + g AS n_features FROM (SELECT count(*) AS u FROM uni), (SELECT count(*) AS g FROM ({_PMI_GE}))"),
    "query_vector_oov": _p(f"SELECT id, n, a, b, round(w, 6) AS w FROM ({_vector('q', 'plain', _PMI_GE).replace('qs s', 'ms s').replace('qt t', 'mt t').replace('qb t', 'mb t')})", _merged("qt"), ", ms AS (SELECT id, list(tok ORDER BY pos) AS tokens FROM mt GROUP BY id), mb AS (SELECT id, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM ms))\n"),
    "cosine_all": _p("SELECT query_id, doc_id, round(cos, 6) AS cos, rank FROM ful", _PLAIN),
    "knn_topk": _p("SELECT query_id, doc_id, round(dist, 6) AS dist, rank FROM near", _PLAIN),
    "knn_zero_norm": "SELECT q.u AS query_id, d.u AS doc_id, 0.0::DOUBLE AS dist, row_number() OVER (PARTITION BY q.u ORDER BY d.u) AS rank FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 20 = 0) q, (SELECT DISTINCT user_id AS u FROM events) d QUALIFY rank <= 5",
    "inverted_index": _p("SELECT 1 AS n, tok AS a, 0 AS b, id AS doc_id, count(*) AS cnt FROM dt GROUP BY tok, id UNION ALL SELECT 2, a, b, id, count(*) FROM db GROUP BY a, b, id"),
    "bigram_match": _p("SELECT q.id AS query_id, d.id AS doc_id, round(round(count(*) / (SELECT len(tokens) - 1 FROM qs WHERE qs.id = q.id), 9), 6) AS score FROM qb q JOIN db d USING (a, b) GROUP BY q.id, d.id"),
    "dense_cosine": _DENSE + " SELECT query_id, doc_id, round(cos, 6) AS cos FROM dc",
    "system_dense": _DENSE + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM dc",
    "cosine_pair": f"WITH {_FRAMES}, nrm AS (SELECT id, sqrt(sum(v * v)) AS nv FROM pool GROUP BY id) SELECT p.id, round(round(sum(p.v * q.v) / (any_value(a.nv) * any_value(b.nv)), 9), 6) AS cos FROM pool p JOIN pool q ON q.id = p.id + 1 AND q.dim = p.dim JOIN nrm a ON a.id = p.id JOIN nrm b ON b.id = q.id GROUP BY p.id",
    "word_utterance_index": f"SELECT unnest(list_distinct({_WORDS})) AS word, doc_id::VARCHAR AS utt_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
    "rank_remainder": _p("SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 50, CASE WHEN rank <= 50 THEN abs(len(d.tokens) - 10 * len(q.tokens)) END, rank) AS rank FROM ful JOIN docs d ON d.id = doc_id JOIN qs q ON q.id = query_id", _PLAIN),
    "regime_gate": _p("SELECT id AS query_id, round(r, 6) AS rho, r < 0.15 AS hard FROM (SELECT id, round(len(tokens) / (SELECT avg(len(tokens)) FROM docs), 9) AS r FROM docs)"),
    "merge_rules": _p(f"SELECT a, b, round(pmi, 6) AS pmi, new_id FROM ({_RULES})"),
    "merge_apply": _p("SELECT id, pos, tok FROM mt", _merged("dt")),
    "merge_query": _p("SELECT id, pos, tok FROM mt", _merged("qt")),
    "merge_diagnostics": _p(f"SELECT {TAU}::DOUBLE AS tau_pmi, 3.0::DOUBLE AS tau_idf, count(*) AS n_merges, count(*) + (SELECT count(*) FROM uni) AS vocabulary FROM ({_RULES})"),
    "system_tfidf": _p(_RANK, _PLAIN),
    "average_precision": _p("SELECT query_id, n_rel, round(ap, 6) AS ap FROM pq", _PLAIN, _per_query()),
    "map_score": _p("SELECT count(*) AS n_queries, round(avg(ap), 6) AS map, d AS dialect FROM pq, unnest(['core', 'sweep', 'strict', 'builder']) u(d) WHERE d IN ('core', 'builder') OR n_rel > 0 GROUP BY d", _PLAIN, _per_query()),
    "precision_at_k": _p("SELECT query_id, round(p1, 6) AS p1, round(p5, 6) AS p5, round(p10, 6) AS p10 FROM pq", _PLAIN, _per_query()),
    "recall_at_k": _p("SELECT query_id, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r10, 6) AS r10 FROM pq", _PLAIN, _per_query()),
    "mrr": _p("SELECT round(avg(rr), 6) AS mrr FROM pq WHERE n_rel > 0", _PLAIN, _per_query()),
    "metrics_all": _p(f"SELECT {_SUMMARY} FROM pq", _PLAIN, _per_query()),
    "macro_avg": "SELECT count(*) AS n_languages, round(avg(map), 5) AS map, round(avg(p1), 5) AS p1 FROM (" + " UNION ALL ".join(f"SELECT * FROM {_in_language(x)}" for x in LANGUAGES) + ")",
    "sig_marker": "SELECT round(i / 2000.0, 6)::DOUBLE AS p, CASE WHEN i / 2000.0 < 0.001 THEN '***' WHEN i / 2000.0 < 0.01 THEN '**' WHEN i / 2000.0 < 0.05 THEN '*' ELSE 'n.s.' END AS marker FROM range(0, 201) t(i)",
    "kmeans_assign": f"WITH {_FRAMES} SELECT utt_id, frame_no, tok, dist FROM asg",
    "centroid_store": f"WITH {_FRAMES} SELECT cluster, dim, round(v, 6) AS v FROM cen",
    "tokenise_batch": f"WITH {_FRAMES} SELECT utt_id AS id, string_agg(tok::VARCHAR, ',' ORDER BY frame_no) AS data FROM asg GROUP BY utt_id",
    "pool_mean": f"WITH {_FRAMES} SELECT id, dim, v FROM pool",
    "pool_max": f"WITH {_FRAMES} SELECT utt_id AS id, dim, round(max(v), 6) AS v FROM fl GROUP BY ALL",
    "pool_attn": f"WITH {_FRAMES}, nw AS (SELECT utt_id, frame_no, exp(nv - max(nv) OVER (PARTITION BY utt_id)) AS x FROM (SELECT utt_id, frame_no, sqrt(sum(v * v)) + 1e-8 AS nv FROM fl GROUP BY ALL)), ww AS (SELECT utt_id, frame_no, x / sum(x) OVER (PARTITION BY utt_id) AS x FROM nw) SELECT fl.utt_id AS id, dim, round(sum(x * v), 6) AS v FROM fl JOIN ww USING (utt_id, frame_no) GROUP BY ALL",
    "build_utterance_queries": f"WITH {_UQ} SELECT * FROM uq",
    "corpus_minus_queries": f"WITH {_UQ} SELECT utt_id, speaker FROM utts WHERE utt_id NOT IN (SELECT utt_id FROM uq)",
    "speaker_join": f"WITH {_UQ} SELECT query_id, u.utt_id AS doc_id FROM uq JOIN utts u USING (speaker) WHERE u.utt_id NOT IN (SELECT utt_id FROM uq)",
    "sw_hard": _p("SELECT query_id, doc_id, sw FROM sw", _PLAIN, _sw("near")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "sw_norm": _p("SELECT query_id, doc_id, round(sw / len(q.tokens), 6) AS sw FROM sw JOIN qs q ON q.id = query_id", _PLAIN, _sw("near")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "rerank_hard": _p(_RERANK, _PLAIN, _sw("near")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "sw_soft": _p("SELECT query_id, doc_id, sw FROM sw", _PLAIN, _SOFT).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "rerank_soft": _p(_RERANK, _PLAIN, _SOFT).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "system_knn_sw": _p(_AFTER, _PLAIN, _sw("near")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "system_knn_sw_k512": _p(_AFTER, _SMOOTH, _TOP, _sw("top")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "system_allbigrams": _p(_AFTER, _cos(_vector("q", "smooth", "SELECT a, b FROM big", 1), _vector("d", "smooth", "SELECT a, b FROM big", 1)), _TOP, _sw("top")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "system_selected": _p(_AFTER, _cos(_vector("q", "smooth", _FREQ, 1), _vector("d", "smooth", _FREQ, 1)), _TOP, _sw("top")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "system_pmi_k512": _p(_AFTER, _cos(_vector("q", "smooth", _PMI_GT, 1), _vector("d", "smooth", _PMI_GT, 1)), _TOP, _sw("top")).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "stream_query_log": _p("SELECT query_id, doc_id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM dot QUALIFY rank <= 10", _PLAIN).replace("round(cos, 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC", "round(dot.cos, 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY dot.cos DESC"),
    "sink_ap_wide": _p("SELECT p.query_id, printf('%.6f', round(p.ap, 6)) AS plain, printf('%.6f', round(s.ap, 6)) AS smooth FROM pq p JOIN pq_s s USING (query_id)", _BOTH),
    "metric_gain": _p("SELECT round((ms - mp) / greatest(mp, 1e-9), 6) AS map_gain, round((ps - pp) / greatest(pp, 1e-9), 6) AS p1_gain FROM (SELECT round(avg(ap), 6) AS mp, round(avg(p1), 6) AS pp FROM pq), (SELECT round(avg(ap), 6) AS ms, round(avg(p1), 6) AS ps FROM pq_s)", _BOTH),
    "wilcoxon": _p("SELECT (SELECT count(*) FROM xy) AS n, coalesce(max(n_used), 0) AS n_used, coalesce(max(wp), 0) AS w_plus, coalesce(max(wm), 0) AS w_minus, coalesce(least(max(wp), max(wm)), 0) AS statistic FROM sums WHERE lang = 'all'", _BOTH, _PAIRS),
    "cohens_d": _p("SELECT count(*) AS n, round(avg(diff), 6) AS mean_diff, round(avg(diff) / (stddev_samp(diff) + 1e-12), 6) AS cohens_d FROM xy", _BOTH, _PAIRS),
    "pooled_test": _p("SELECT lang, n, coalesce(n_used, 0) AS n_used, CASE WHEN n >= 10 THEN wp END AS w_plus, CASE WHEN n >= 10 THEN wm END AS w_minus, CASE WHEN n >= 10 THEN least(wp, wm) END AS statistic FROM (SELECT lang, count(*) AS n FROM tests GROUP BY lang) LEFT JOIN sums USING (lang)", _BOTH, _PAIRS),
    "best_config": _p(
        "SELECT model, config, map FROM rowz QUALIFY row_number() OVER (PARTITION BY model ORDER BY map DESC, config) = 1 UNION ALL SELECT 'all', config, map FROM (SELECT * FROM rowz ORDER BY map DESC, config LIMIT 1)",
        _BOTH,
        ", rowz AS (SELECT d AS model, d || '-plain' AS config, round(avg(ap), 6) AS map FROM pq, unnest(['core', 'sweep', 'strict', 'builder']) u(d) WHERE d IN ('core', 'builder') OR n_rel > 0 GROUP BY d UNION ALL SELECT d, d || '-smooth', round(avg(ap), 6) FROM pq_s, unnest(['core', 'sweep', 'strict', 'builder']) u(d) WHERE d IN ('core', 'builder') OR n_rel > 0 GROUP BY d)\n",
    ),
    "mtwv": _p(
        "SELECT query_id, round(coalesce(max(1 - (1 - t / nullif(n_true, 0) + CASE WHEN n_true > 0 THEN n_false / n_true ELSE 0 END * CASE WHEN n_false > 0 THEN f / n_false ELSE 0 END)), 0), 6) AS mtwv FROM (SELECT s.query_id, n_true, n - n_true AS n_false, k, coalesce(sum(c.t) OVER w, 0) AS t, coalesce(sum(c.f) OVER w, 0) AS f FROM span s, range(300) g(k) LEFT JOIN cell c ON c.query_id = s.query_id AND c.step = k WINDOW w AS (PARTITION BY s.query_id ORDER BY k DESC)) GROUP BY query_id",
        _PLAIN,
        ", sc AS (SELECT f.query_id, f.doc_id, round(cos, 6) AS s, (r.doc_id IS NOT NULL)::INT AS tr FROM ful f LEFT JOIN (SELECT DISTINCT * FROM rel) r ON r.query_id = f.query_id AND r.doc_id = f.doc_id), span AS (SELECT query_id, min(s) AS lo, max(s) AS hi, sum(tr) AS n_true, count(*) AS n FROM sc GROUP BY query_id), cell AS (SELECT query_id, CASE WHEN hi > lo THEN floor(round((s - lo) / (hi - lo) * 299, 9)) ELSE 299 END AS step, sum(tr) AS t, sum(1 - tr) AS f FROM sc JOIN span USING (query_id) GROUP BY ALL)\n",
    ),
    "seed_mean_std": _p("SELECT count(*) AS n_seeds, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (" + " UNION ALL ".join(f"SELECT avg(ap) AS m FROM pq_{k} WHERE n_rel > 0" for k in (1, 2, 3)) + ")", *(_random(k) for k in (1, 2, 3))),
    "uniform_align": f"WITH {_UTTS}, w AS (SELECT utt_id, round(size * 0.3, 3)::DOUBLE AS dur, {_WORDS.replace('text', 'transcript')} AS ws FROM utts) SELECT utt_id, i - 1 AS pos, ws[i] AS word, round((i - 1) * (dur / len(ws)) + 1e-9, 6) AS start_s, round(i * (dur / len(ws)) + 1e-9, 6) AS end_s FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)",
    "build_word_queries": f"""WITH {_UTTS}, w AS (SELECT utt_id, round(size * 0.3, 3)::DOUBLE AS dur, {_WORDS.replace('text', 'transcript')} AS ws FROM utts),
ix AS (SELECT DISTINCT utt_id, unnest(ws) AS word FROM w), dr AS (SELECT word FROM ix GROUP BY word HAVING count(*) >= 10 ORDER BY md5(concat_ws('_', word, '42')), word LIMIT 200),
so AS (SELECT word, utt_id, row_number() OVER (PARTITION BY word ORDER BY md5(concat_ws('_', word, utt_id, '42')), utt_id) AS place FROM ix JOIN dr USING (word) QUALIFY place <= 10),
sp AS (SELECT utt_id, i AS pos, ws[i] AS word, round((i - 1) * (dur / len(ws)) + 1e-9, 6) AS b, round(i * (dur / len(ws)) + 1e-9, 6) AS e FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w))
SELECT 'q_' || word || '_' || utt_id AS query_id, word, utt_id AS source_utt, b AS "start", e AS "end" FROM so JOIN sp USING (word, utt_id) WHERE e - b BETWEEN 0.15 AND 1.5 QUALIFY row_number() OVER (PARTITION BY word ORDER BY place, pos) = 1""",
}
