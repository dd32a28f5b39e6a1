"""Paired significance tests over per-query values (query_id, x, y), by groups."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 10
EXACT = 50


def paired(values: DataFrame, one: str, two: str) -> DataFrame:
    """(query_id, x, y) of (query_id, system, ap): queries that both systems have."""
    x = values.filter(F.col("system") == one).select("query_id", F.col("ap").alias("x"))
    y = values.filter(F.col("system") == two).select("query_id", F.col("ap").alias("y"))
    return x.join(y, "query_id")


def signed_ranks(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs with diff (9 places) and the average rank of its size; equal pairs are left out."""
    keys = ", ".join(by)
    part = f"partition by {keys} " if by else ""
    whole = f"partition by {keys + ', ' if by else ''}abs(diff)"
    x = pairs.withColumn("diff", F.round(F.col("x") - F.col("y"), 9)).filter("diff <> 0")
    return x.withColumn("rank", F.expr(f"rank() over ({part}order by abs(diff)) + (count(*) over ({whole}) - 1) / 2.0").cast("double")).withColumn("ties", F.expr(f"count(*) over ({whole})"))


def wilcoxon(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group: n, n_used, w_plus, w_minus, statistic, mean_diff, cohens_d, p_two, p_greater, effect_r.

    With fewer than LEAST pairs the test's values are null.  P-values are exact
    for up to EXACT pairs of which none are equal and no two differences are
    alike; else those of the normal approximation, corrected for ties.
    """
    ranks = signed_ranks(pairs, by)
    plus, minus = (F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0)) for c in (F.col("diff") > 0, F.col("diff") < 0))
    sums = ranks.groupBy(*by).agg(F.count("*").alias("n_used"), plus.alias("w_plus"), minus.alias("w_minus"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    diff = F.round(F.col("x") - F.col("y"), 9)
    base = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"))
    x = base.join(sums, list(by), "left") if by else base.join(sums)
    x = x.withColumn("cohens_d", F.col("mean_diff") / (F.col("sd") + 1e-12)).withColumn("statistic", F.least("w_plus", "w_minus"))
    names = [*by, "n", "n_used", "w_plus", "w_minus", "statistic", "mean_diff", "cohens_d"]
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in x.select(*names).schema])  # any may be null
    for c in ("p_two", "p_greater", "effect_r"):
        kind = kind.add(c, "double")

    def test(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                rows.append(p_values(r.n, r.n_used, r.w_plus, r.tied, r.mean_diff))
            out = f[names].copy()
            for k, c in enumerate(("p_two", "p_greater", "effect_r")):
                out[c] = pd.Series([x[k] for x in rows], index=out.index, dtype="float64")
            small = out["n"] < LEAST
            out.loc[small, ["w_plus", "w_minus", "statistic", "cohens_d"]] = None
            yield out

    return x.select(*names, "tied").mapInPandas(test, kind)


def p_values(n: int, used: float, plus: float, tied: float, mean: float) -> tuple[float | None, float | None, float | None]:
    """Two-sided p, p of "x is greater", and the effect r = z sign / sqrt(n)."""
    if n < LEAST or not used or math.isnan(used):
        return None, None, None
    mu = used * (used + 1) / 4
    var = used * (used + 1) * (2 * used + 1) / 24 - tied / 48
    if var <= 0:
        return None, None, None
    if n == used and n <= EXACT and not tied:
        ways = rank_sums(int(n))
        below, above = sum(ways[: int(plus) + 1]) / 2 ** int(n), sum(ways[int(plus) :]) / 2 ** int(n)
        two, greater = min(1.0, 2 * min(below, above)), above
    else:
        z = (plus - mu) / math.sqrt(var)
        two, greater = math.erfc(abs(z) / math.sqrt(2)), 0.5 * math.erfc(z / math.sqrt(2))
    effect = NormalDist().inv_cdf(1 - two / 2) * math.copysign(1, mean) / math.sqrt(n) if 0 < two < 1 and 1 - two / 2 < 1 else (0.0 if two >= 1 else math.copysign(math.inf, mean))
    return two, greater, effect


def rank_sums(n: int) -> list[int]:
    """In how many ways some of the ranks 1 to n add up to each sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        ways = [w + (ways[s - rank] if s >= rank else 0) for s, w in enumerate(ways)]
    return ways


def sig_marker(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def pooled(values: DataFrame, one: str, two: str) -> DataFrame:
    """`wilcoxon` over all languages (lang 'all', queries told apart as lang::query) and for each, of (lang, query_id, system, ap)."""
    named = values.select("lang", F.concat_ws("::", "lang", "query_id").alias("query_id"), "system", "ap")
    pairs = paired(named, one, two).withColumn("lang", F.element_at(F.split("query_id", "::"), 1))
    return wilcoxon(pairs.select(F.explode(F.array(F.lit("all"), F.col("lang"))).alias("lang"), "query_id", "x", "y"), ("lang",))
