"""Operators and systems against plain Python on small fixtures."""

import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import kernels
from seqloom.operators import align, dense, merge, metrics, retrieve, signif, stats, vectorize
from seqloom.plans import systems
from seqloom.sources import readers, writers
from seqloom.sources.shared import fresh

SEQS = "id long, tokens array<long>"


@pytest.fixture(scope="module")
def planted(spark):
    """Random documents, some with a query's pattern in them, an empty one, one of length 1, and two copies."""
    rng = random.Random(42)
    docs = [[rng.randrange(20) for _ in range(rng.randrange(20, 60))] for _ in range(40)]
    queries, rel = [], []
    for q in range(6):
        pattern = [rng.randrange(20) for _ in range(12)]
        queries.append(pattern)
        for d in rng.sample(range(40), 3):
            at = rng.randrange(len(docs[d]))
            docs[d][at:at] = pattern
            rel.append((q, d))
    docs += [[], [7], docs[0], docs[1]]
    queries += [[], [99, 98], docs[5]]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), SEQS)
    return docs, queries, rel, frame(docs), frame(queries), spark.createDataFrame(rel, "query_id long, doc_id long")


class Brute:
    """The systems in plain Python, with the same rounding and ties."""

    def __init__(self, docs, config):
        self.docs, self.c = docs, config
        n = len(docs)
        df = Counter(t for d in docs for t in set(d))
        plus = 1 if config.smooth else 0
        self.idf = {(1, t, 0): math.log(n / (k + plus)) for t, k in df.items()}
        uni, big = Counter(t for d in docs for t in d), Counter(p for d in docs for p in zip(d, d[1:]))
        nt, nb = sum(uni.values()), sum(big.values())
        self.pmi = {p: round(math.log((k / nb) / ((uni[p[0]] / nt) * (uni[p[1]] / nt))), 12) for p, k in big.items()}
        self.lookup = {}
        for p in [p for p in self.pmi if big[p] >= config.min_count]:
            self.lookup.setdefault(p[0], {}).setdefault(p[1], self.pmi[p])
        for p in [p for p in self.pmi if big[p] >= config.min_count]:
            self.lookup.setdefault(p[1], {})[p[0]] = self.pmi[p]
        chosen = []
        if config.bigrams == "pmi":
            chosen = [p for p, v in self.pmi.items() if big[p] >= config.min_count and (v > config.tau if config.strict else v >= config.tau)]
        elif config.bigrams == "all":
            chosen = list(big)
        dfb = Counter(p for d in docs for p in set(zip(d, d[1:])))
        self.idf |= {(2, *p): config.alpha * math.log(n / (dfb[p] + plus)) for p in chosen}
        self.rules = {}
        if config.merging:
            good = [p for p, v in self.pmi.items() if big[p] >= 2 and v >= merge.TAU_PMI and max(math.log(n / df[p[0]]), math.log(n / df[p[1]])) <= merge.TAU_IDF]
            good.sort(key=lambda p: (-self.pmi[p], p))
            self.rules = {p: max(uni) + 1 + i for i, p in enumerate(good[: config.max_merges])}
        self.aligned = [self.apply(d) for d in docs]
        self.vectors = [self.vector(d) for d in docs]

    def apply(self, seq):
        out, i = [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) in self.rules:
                out.append(self.rules[tuple(seq[i : i + 2])])
                i += 2
            else:
                out.append(seq[i])
                i += 1
        return out

    def vector(self, seq):
        terms = Counter((1, t, 0) for t in seq)
        if self.c.bigrams:
            terms += Counter((2, a, b) for a, b in zip(seq, seq[1:]))
        w = {f: k / (len(seq) if f[0] == 1 else len(seq) - 1) * self.idf[f] for f, k in terms.items() if f in self.idf and self.idf[f]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {f: x / norm for f, x in w.items()}

    def rank(self, query):
        q = self.apply(query)
        v = self.vector(q)
        cos = [round(sum(x * d.get(f, 0) for f, x in v.items()), 9) for d in self.vectors]
        order = sorted(range(len(self.docs)), key=lambda d: (-cos[d], d))
        if self.c.align is None:
            return order
        dist = [round((bool(v) + bool(d)) / 2 - c, 9) for d, c in zip(self.vectors, cos, strict=True)]
        near = sorted(range(len(self.docs)), key=lambda d: (dist[d], d))[: self.c.k] if self.c.euclid else order[: self.c.k]
        arrays = [np.array(self.aligned[d], np.int64) for d in near]
        soft = self.c.align == "gated" and self.c.gate and len(q) / (sum(map(len, self.aligned)) / len(self.docs)) >= self.c.rho
        query_array = np.array(q, np.int64)
        sw = kernels.smith_waterman_soft(query_array, arrays, self.lookup).round(4) if soft else kernels.smith_waterman(query_array, arrays)
        best = sorted(zip(near, sw.tolist(), range(len(near)), strict=True), key=lambda x: (-x[1], x[2] if self.c.euclid else order.index(x[0])))
        # ties follow the cosine ranking over all documents
        best = sorted(best, key=lambda x: (-x[1], order.index(x[0])))
        first = [d for d, _, _ in best]
        return first + [d for d in order if d not in set(first)]


CONFIGS = [
    systems.TFIDF,
    replace(systems.KNN_SW, k=8),
    replace(systems.FULL, k=8, tau=0.5, max_merges=10),
    replace(systems.FULL, k=8, tau=0.5, max_merges=10, rho=0.0),
    replace(systems.FULL, k=100, tau=0.5, merging=False, gate=False),
    replace(systems.ALL_BIGRAMS, k=8),
    replace(systems.PMI_SMOOTH, k=8),
]


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: f"{c.name}-{c.k}-{c.rho}")
def test_systems_against_plain_python(planted, config):
    docs, queries, rel, d, q, r = planted
    fitted = systems.fit(d, config)
    got = defaultdict(list)
    for row in fitted.rank(q).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append(row["doc_id"])
    brute = Brute(docs, config)
    for i, query in enumerate(queries):
        assert got[i] == brute.rank(query), i
    ranks = {(x["query_id"], x["doc_id"]): x["rank"] for x in fitted.relevant_ranks(q, r).collect()}
    assert ranks == {(a, b): got[a].index(b) + 1 for a, b in rel}


def test_planted_documents_rank_on_top(planted):
    _, _, rel, d, q, r = planted
    values = systems.fit(d, replace(systems.KNN_SW, k=44)).evaluate(q, r, metrics.STRICT)
    assert values.agg(F.avg("ap")).first()[0] > 0.95


def test_dtw_and_bigram_index(planted):
    docs, queries, _, d, q, _ = planted
    got = {(x["query_id"], x["doc_id"]): x["dist"] for x in align.dtw_all(q, d, 5).collect()}
    for i, query in enumerate(queries):
        want = kernels.dtw(np.array(query, np.int64), [np.array(x, np.int64) for x in docs], 5)
        assert [got[i, j] for j in range(len(docs))] == [round(x, 9) for x in want.tolist()]
    matched = retrieve.bigram_match(q, retrieve.inverted_index(d))
    scores = {(x["query_id"], x["doc_id"]): x["score"] for x in matched.collect()}
    for i, query in enumerate(queries):
        pairs = list(zip(query, query[1:]))
        index = [Counter(zip(x, x[1:])) for x in docs]
        want = {j: sum(c[p] for p in pairs) / len(pairs) for j, c in enumerate(index) if any(c[p] for p in pairs)} if pairs else {}
        if not want and query:
            want = {j: sum(Counter(x)[t] for t in query) / len(query) for j, x in enumerate(docs) if set(query) & set(x)}
        assert {j: s for (a, j), s in scores.items() if a == i} == {j: round(s, 9) for j, s in want.items()}


def test_merge_is_the_greedy_pass(spark):
    rng = random.Random(3)
    docs = [[1, 1, 1], [], [5], *([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(60))]
    rules = {(1, 1): 10, (1, 2): 11, (2, 1): 12, (3, 0): 13}
    table = spark.createDataFrame([(a, b, n) for (a, b), n in rules.items()], "a long, b long, new_id long")
    got = {r["id"]: r["tokens"] for r in merge.merge_arrays(spark.createDataFrame(list(enumerate(docs)), SEQS), table).collect()}
    brute = Brute.__new__(Brute)
    brute.rules = rules
    assert [got[i] for i in range(len(docs))] == [brute.apply(d) for d in docs]


def test_pmi_lookup_prefers_the_reverse(spark):
    values = spark.createDataFrame([(1, 2, 5, 0.5), (2, 1, 5, 0.7), (3, 4, 5, 0.1)], "a long, b long, cnt long, pmi double")
    got = {(r["x"], r["y"]): r["s"] for r in stats.pmi_lookup(values).collect()}
    assert got == {(1, 2): 0.7, (2, 1): 0.5, (3, 4): 0.1, (4, 3): 0.1}


def test_no_bigrams_means_unigrams(planted):
    _, _, _, d, _, _ = planted
    one = vectorize.features(vectorize.unigram_vocabulary(d))
    chosen = systems.choose_bigrams(d, replace(systems.FULL, tau=99.0))
    two = vectorize.features(vectorize.unigram_vocabulary(d), vectorize.bigram_vocabulary(d, chosen))
    a, b = vectorize.tfidf(d, one), vectorize.tfidf(d, two, True)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_zero_vectors_are_near_each_other(spark):
    docs = spark.createDataFrame([(0, [1]), (1, [1, 2]), (2, [1, 3])], SEQS)
    vocabulary = vectorize.features(vectorize.unigram_vocabulary(docs))
    vectors = vectorize.tfidf(docs, vocabulary)
    got = retrieve.knn(docs, docs, vectors, vectors, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"], r["dist"]) for r in got] == [(0, 0, 0.0), (0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.0), (1, 0, 0.5), (1, 2, 1.0), (2, 2, 0.0), (2, 0, 0.5), (2, 1, 1.0)]


@pytest.mark.parametrize("name", list(metrics.DIALECTS))
def test_dialects(spark, name):
    dialect = metrics.DIALECTS[name]
    queries = spark.createDataFrame([(i,) for i in range(4)], "id long")
    docs = spark.createDataFrame([(i,) for i in range(10)], "id long")
    rel = spark.createDataFrame([(0, 1), (0, 50), (1, None), (2, 3)], "query_id long, doc_id long")  # 3 is missing, 1 has an empty list
    ranked = spark.createDataFrame([(q, d, d + 1) for q in range(4) for d in range(10)], "query_id long, doc_id long, rank long")
    got = {r["query_id"]: r for r in metrics.per_query(ranked, rel, metrics.judged_queries(queries, rel, dialect, docs)).collect()}
    n = 1 if dialect.restrict_to_corpus else 2
    assert got[0]["ap"] == 0.5 / n and got[0]["p5"] == 0.2 and got[0]["r5"] == 1 / n and got[2]["rr"] == 0.25
    assert (3 in got) == dialect.include_missing and (1 in got) == dialect.include_empty
    assert all(got[k]["ap"] == 0 for k in (1, 3) if k in got)


def test_mtwv(spark):
    rng = random.Random(9)
    scores = [(q, d, round(rng.random(), 3)) for q in range(3) for d in range(30)] + [(3, d, 0.5) for d in range(4)]
    rel = [(0, 1), (0, 2), (1, 5), (3, 0)]
    got = {r["query_id"]: r["mtwv"] for r in metrics.mtwv(spark.createDataFrame(scores, "query_id long, doc_id long, cos double"), spark.createDataFrame(rel, "query_id long, doc_id long")).collect()}
    for q in range(4):
        own = {d: s for a, d, s in scores if a == q}
        true = {d for a, d in rel if a == q}
        best = 0.0
        if true:
            lo, hi, false = min(own.values()), max(own.values()), len(own) - len(true)
            best = max(1 - (1 - sum(own[d] >= t - 1e-9 for d in true) / len(true) + false / len(true) * sum(own[d] >= t - 1e-9 for d in own if d not in true) / max(false, 1)) for t in np.linspace(lo, hi, 300))
        assert got[q] == pytest.approx(best, abs=1e-6)


def test_wilcoxon(spark):
    x = [0.9, 0.8, 0.7, 0.6, 0.5, 0.55, 0.4, 0.3, 0.95, 0.2, 0.1, 0.5]
    y = [0.7, 0.85, 0.5, 0.6, 0.3, 0.45, 0.5, 0.1, 0.75, 0.3, 0.05, 0.2]
    pairs = spark.createDataFrame([(f"q{i}", a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "query_id string, x double, y double")
    r = signif.wilcoxon(pairs).first()
    diff = [round(a - b, 9) for a, b in zip(x, y, strict=True) if a != b]
    size = sorted(map(abs, diff))
    rank = lambda v: sum(i + 1 for i, s in enumerate(size) if s == v) / size.count(v)
    plus, minus = sum(rank(abs(v)) for v in diff if v > 0), sum(rank(abs(v)) for v in diff if v < 0)
    assert (r["n"], r["n_used"], r["w_plus"], r["w_minus"], r["statistic"]) == (12, 11, plus, minus, min(plus, minus))
    mu, var = 11 * 12 / 4, 11 * 12 * 23 / 24 - sum(k**3 - k for k in Counter(size).values()) / 48
    assert r["p_two"] == pytest.approx(math.erfc(abs(plus - mu) / math.sqrt(var) / math.sqrt(2)))
    assert r["p_greater"] == pytest.approx(r["p_two"] / 2)
    few = signif.wilcoxon(pairs.limit(5)).first()
    assert few["n"] == 5 and few["p_two"] is None and few["statistic"] is None


def test_token_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Tokens\nx/one.wav,"1, 2,-3,z"\ntwo.a.wav,\none.wav,"4,5"\n,7\n')
    read = lambda d: {r["id"]: r["tokens"] for r in readers.read_token_csv(spark, str(tmp_path / "a.csv"), d).collect()}
    assert read(readers.MAIN) == {"one": [4, 5]}
    assert read(readers.SWEEP) == {"one": [4, 5], "two.a": []}
    (tmp_path / "b.csv").write_text('stem,d\nq,"[1, 2]"\n')
    assert {r["id"]: r["tokens"] for r in readers.read_token_csv(spark, str(tmp_path / "b.csv"), replace(readers.SWEEP, by_position=True)).collect()} == {"q": [1, 2]}


def test_ground_truth(spark):
    rel = spark.createDataFrame([("q_A_x", "d1"), ("q_B_x", "d2"), ("y", None), ("q_C_y", "d1"), ("z", "d9"), ("z", "d2")], "query_id string, doc_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id string")
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    got = sorted(tuple(r) for r in readers.resolve_ground_truth(ids("x", "y", "z", "w"), docs, rel).collect())
    assert got == [("x", "d2", "q_B_x"), ("y", "d1", "q_C_y"), ("z", "d2", "z")]


def test_relevance_round_trip(spark):
    at = fresh(spark, "rel")
    writers.write_relevance(spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "query_id long, doc_id long"), at)
    assert sorted(tuple(r) for r in readers.read_relevance(spark, at).collect()) == [("1", "2"), ("1", "3"), ("4", "5")]


def test_quantisation(spark):
    frames = spark.createDataFrame([(0, i, [float(i % 2 * 10), float(i % 3)], i % 2) for i in range(12)], "utt_id long, frame_no int, embedding array<double>, label int")
    learned = dense.kmeans_fit(frames, 2)
    told = dense.kmeans_assign(frames, learned).select("label", "tok").distinct()
    assert told.count() == 2
    at = fresh(spark, "centroids")
    dense.write_centroids(learned, at, "m", 3)
    assert dense.read_centroids(spark, at, "m", 3).count() == 2
    with pytest.raises(ValueError):
        dense.read_centroids(spark, at, "m", 4)
    files = spark.createDataFrame([("a/u1.wav", bytearray(b"\x01\x02")), ("bad.wav", bytearray())], "path string, content binary")

    def encoder():
        def of(content):
            if not content:
                raise ValueError("empty")
            return [[float(x)] for x in content]

        return of

    got = {(r["utt_id"], r["frame_no"]): (r["embedding"], r["error"]) for r in dense.extract(files, encoder).collect()}
    assert got == {("u1", 0): ([1.0], None), ("u1", 1): ([2.0], None), ("bad", None): (None, "ValueError: empty")}


def test_a_language_that_fails_is_named(spark, monkeypatch):
    from seqloom.plans import systems

    done = []

    def sweep(d, q, *_):
        done.append(1)
        if len(done) == 1:
            raise MemoryError
        return q

    monkeypatch.setattr(systems, "sweep", sweep)
    monkeypatch.setattr(systems, "stored", lambda df, name: df)
    docs = spark.createDataFrame([], "lang string, id long, tokens array<bigint>")
    with pytest.raises(ValueError, match="de: MemoryError"):
        systems.by_language(docs, docs, spark.createDataFrame([], "query_id long, doc_id long"), ["de", "en"])
    assert len(done) == 2
