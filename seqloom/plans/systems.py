"""Retrieval systems as compositions of the operators, and sweeps over them.

`fit` turns a corpus (id, tokens) into stored tables; `Fitted.rank` ranks all
queries at once.  `Fitted.evaluate` finds the ranks of relevant documents by
counting, so that no task sorts a whole corpus.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, merge, metrics, scores, select, stats, vectorize
from ..sources.shared import stored


@dataclass(frozen=True)
class Config:
    """What a system is made of.

    bigrams: None, 'pmi', 'all', 'frequency' or 'random'.  align: None (cosine
    decides), 'hard', 'norm' or 'gated'.  euclid: candidates by the distance of
    unit vectors, else by cosine.
    """

    name: str
    bigrams: str | None = None
    tau: float = 1.5
    strict: bool = False
    min_count: int = 2
    n: int = 700
    seed: int = 42
    alpha: float = 0.5
    smooth: bool = False
    align: str | None = None
    euclid: bool = True
    k: int = 50
    merging: bool = False
    max_merges: int | None = merge.MAX_MERGES
    gate: bool = True
    rho: float = 0.15
    scale: float = 1.0


AT_ONCE = 4

TFIDF = Config("tfidf")
KNN_SW = Config("knn_sw", align="hard")
FULL = Config("pmi_merge_sw", bigrams="pmi", align="gated", merging=True)
ALL_BIGRAMS = Config("all_bigrams", bigrams="all", smooth=True, align="norm", euclid=False)
SELECTED = Config("selected", bigrams="frequency", smooth=True, strict=True, min_count=1, align="norm", euclid=False)
KNN_SW_SMOOTH = Config("knn_sw_smooth", smooth=True, align="norm", euclid=False)
PMI_SMOOTH = Config("pmi_smooth", bigrams="pmi", tau=0.5, strict=True, min_count=1, smooth=True, align="norm", euclid=False)

COMPARED = (TFIDF, KNN_SW, FULL)
ABLATION = (
    TFIDF,
    KNN_SW,
    FULL,
    replace(FULL, name="no_merging", merging=False),
    replace(FULL, name="merges_20", max_merges=20),
    replace(FULL, name="merges_100", max_merges=100),
    replace(FULL, name="no_bigrams", bigrams=None),
    replace(FULL, name="tau_0.5", tau=0.5),
    replace(FULL, name="tau_1.5", tau=1.5),
    replace(FULL, name="tau_2.0", tau=2.0),
    replace(FULL, name="alpha_0.25", alpha=0.25),
    replace(FULL, name="alpha_1.0", alpha=1.0),
)


def choose_bigrams(arrays: DataFrame, config: Config, values: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame | None:
    """(a, b) of the bigrams that a configuration takes as features."""
    if config.bigrams is None:
        return None
    counted = stats.counted(arrays) if counted is None else counted
    counts = stats.pairs_of(counted).select("a", "b", "cnt")
    if config.bigrams == "all":
        return select.everything(counts)
    if config.bigrams == "frequency":
        return select.by_frequency(counts, config.n)
    if config.bigrams == "random":
        return select.at_random(counts, config.n, config.seed)
    return select.by_pmi(pmi_of(counted, config.min_count) if values is None else values, config.tau, config.strict)


def pmi_of(counted: DataFrame, min_count: int = 2) -> DataFrame:
    return stats.pmi(stats.unigrams_of(counted), stats.pairs_of(counted), min_count)


def pmi_values(arrays: DataFrame, min_count: int = 2) -> DataFrame:
    return pmi_of(stored(stats.counted(arrays), "counted"), min_count)


@dataclass
class Fitted:
    """A corpus ready for queries: its tables are written and read again."""

    config: Config
    docs: DataFrame
    aligned: DataFrame
    vocabulary: DataFrame
    rules: DataFrame | None
    lookup: DataFrame | None

    @property
    def with_bigrams(self) -> bool:
        return self.config.bigrams is not None

    @cached_property
    def vectors(self) -> DataFrame:
        """The documents' vectors as rows, for joins; rankings don't need them."""
        return stored(vectorize.tfidf(self.docs, self.vocabulary, self.with_bigrams), "vectors")

    def compressed(self, queries: DataFrame) -> DataFrame:
        return queries if self.rules is None else merge.merge_arrays(queries, self.rules)

    def reranked(self, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """(query_id, doc_id, score, sw, rank) of the candidates (query_id, doc_id, score) of compressed queries: ties go by score, then id."""
        pairs = align.pair_tokens(candidates.select("query_id", "doc_id"), queries, self.aligned)
        if self.config.align == "gated" and self.config.gate:
            gate = align.regime_gate(queries, self.aligned, self.config.rho)
            aligned = align.gated(stored(pairs, "pairs"), gate, self.lookup, self.config.scale)
        else:
            aligned = align.sw_hard(pairs)
        x = candidates.select("query_id", "doc_id", "score").join(aligned, ["query_id", "doc_id"])
        order = F.expr("row_number() over (partition by query_id order by sw desc, score desc, doc_id)")
        return stored(x.withColumn("rank", order.cast("long")), "reranked")

    def rank(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, rank): the full ranking of every query."""
        own = stored(self.compressed(queries), "queries")
        blocks = scores.cosine(own, self.vocabulary, self.with_bigrams)
        best = None
        if self.config.align is not None:
            best = self.reranked(own, scores.picked(self.docs, own, blocks, self.config.k, self.config.euclid))
        return scores.ranking(self.docs, own, blocks, best).select("query_id", "doc_id", "rank")

    def relevant_ranks(self, queries: DataFrame, relevance: DataFrame) -> DataFrame:
        """(query_id, doc_id, rank) of relevant documents, by counting who stands before them."""
        own = stored(self.compressed(queries), "queries")
        rel = relevance.select("query_id", "doc_id").filter("doc_id is not null").distinct()
        named = scores.few(rel)
        if named is None:
            return self.rank(queries).join(rel, ["query_id", "doc_id"], "left_semi")
        blocks = scores.cosine(own, self.vocabulary, self.with_bigrams)
        if self.config.align is None:
            return scores.standing(self.docs, own, blocks, scores.picked(self.docs, own, blocks, named=named))
        found = scores.picked(self.docs, own, blocks, self.config.k, self.config.euclid, named)
        best = self.reranked(own, found.filter("rank is not null"))
        inside = best.join(rel, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "rank")
        others = found.filter("rank is null").join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        return inside.union(scores.standing(self.docs, own, blocks, others, best.select("query_id", "doc_id").toArrow()))

    def evaluate(self, queries: DataFrame, relevance: DataFrame, dialect: metrics.Dialect = metrics.CORE) -> DataFrame:
        """Per-query metrics, with the system's name."""
        return self.judged(self.relevant_ranks(queries, relevance), queries, relevance, dialect)

    def judged(self, ranks: DataFrame, queries: DataFrame, relevance: DataFrame, dialect: metrics.Dialect) -> DataFrame:
        """`evaluate` by ranks that are there already."""
        judged = metrics.judged_queries(queries, relevance, dialect, self.docs)
        return metrics.per_query(ranks, relevance, judged).withColumn("system", F.lit(self.config.name))


def compress(docs: DataFrame, config: Config, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules of a configuration that merges, and the documents after them."""
    rules = stored(merge.merge_rules(docs, max_merges=config.max_merges, counted=counted), "rules")
    return rules, stored(merge.merge_arrays(docs, rules), "merged")


def fit(docs: DataFrame, config: Config, counted: DataFrame | None = None, merged: tuple[DataFrame, DataFrame] | None = None) -> Fitted:
    """docs: (id, tokens), a stored table, as it is read several times; counted, merged: its `stats.counted` and `compress`, if they are there already."""
    rules, aligned, values = None, docs, None
    counted = stored(stats.counted(docs), "counted") if counted is None else counted
    if config.merging:
        rules, aligned = compress(docs, config, counted) if merged is None else merged
    if config.align == "gated" or config.bigrams == "pmi":
        values = stored(pmi_of(counted, config.min_count), "pmi")
    chosen = choose_bigrams(docs, config, values, counted)
    pairs = None if chosen is None else vectorize.bigram_vocabulary(docs, stored(chosen.select("a", "b"), "bigrams"), config.smooth, counted)
    vocabulary = stored(vectorize.features(vectorize.unigram_vocabulary(docs, config.smooth, counted), pairs, config.alpha), "vocabulary")
    lookup = None if config.align != "gated" else stats.pmi_lookup(values)
    return Fitted(config, docs, aligned, vocabulary, rules, lookup)


def sweep(docs: DataFrame, queries: DataFrame, relevance: DataFrame, configs: tuple[Config, ...], dialect: metrics.Dialect = metrics.CORE) -> DataFrame:
    """Per-query metrics of every configuration, one under another.

    Counts, and documents merged by the same number of rules, are shared;
    AT_ONCE configurations are worked on at a time, as each is many short jobs.
    """
    queries, counted = stored(queries.select("id", "tokens"), "queries"), stored(stats.counted(docs), "counted")
    merged = {c.max_merges: c for c in configs if c.merging}
    merged = {n: compress(docs, c, counted) for n, c in merged.items()}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        each = list(pool.map(lambda c: fit(docs, c, counted, merged[c.max_merges] if c.merging else None).evaluate(queries, relevance, dialect), configs))
    return reduce(DataFrame.unionByName, each)


def by_language(docs: DataFrame, queries: DataFrame, relevance: DataFrame, languages: list[str], configs: tuple[Config, ...] = COMPARED, dialect: metrics.Dialect = metrics.STRICT) -> DataFrame:
    """`sweep` within each language of docs and queries (lang, id, tokens); if some fail, the others are done first, then an error names them.

    The languages are a stated list; each has statistics of its own.
    """
    out, failed = None, []
    for lang in languages:
        try:
            d, q = docs.filter(F.col("lang") == lang).select("id", "tokens"), queries.filter(F.col("lang") == lang).select("id", "tokens")
            rel = relevance.join(q.select(F.col("id").alias("query_id")), "query_id", "left_semi")
            one = stored(sweep(d, q, rel, configs, dialect).withColumn("lang", F.lit(lang)), "language")
        except Exception as e:
            failed.append(f"{lang}: {type(e).__name__}")
            continue
        out = one if out is None else out.unionByName(one)
    if failed or out is None:
        raise ValueError("; ".join(failed) or "no language")
    return out


def gains(summary: DataFrame, new: str, old: str, by: tuple[str, ...] = ()) -> DataFrame:
    """map_gain and p1_gain of one system over another, from rows with system, map and p1."""
    side = lambda name, k: summary.filter(F.col("system") == name).select(*by, F.col("map").alias(f"map_{k}"), F.col("p1").alias(f"p1_{k}"))
    x = side(new, "new").join(side(old, "old"), list(by)) if by else side(new, "new").join(side(old, "old"))
    g = lambda m: F.round(metrics.gain(F.col(f"{m}_new"), F.col(f"{m}_old")), 6)
    return x.select(*by, g("map").alias("map_gain"), g("p1").alias("p1_gain"))


def report(rows: list[dict], columns: list[str]) -> str:
    """A text table of a few result rows."""
    cells = [columns, *([f"{r.get(c):.4f}" if isinstance(r.get(c), float) else str(r.get(c, "")) for c in columns] for r in rows)]
    width = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, width, strict=True)).rstrip() for row in cells)


def latex_markers(rows: list[dict]) -> str:
    """Lines ``name & value^{marker} \\\\`` of rows with name, value and marker."""
    return "\n".join(rf"{r['name']} & ${r['value']:.3f}^{{{'' if r['marker'] == 'n.s.' else r['marker']}}}$ \\" for r in rows)
