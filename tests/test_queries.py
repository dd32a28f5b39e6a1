"""The catalogue's queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from seqloom.operators import signif
from seqloom.plans import catalog
from seqloom.plans.catalog import QUERIES
from seqloom.plans.oracles import ORACLES

#: Alignments take DuckDB half a minute each; one of them is enough here.
SLOW = {"sw_norm", "sw_soft", "rerank_hard", "system_knn_sw", "system_knn_sw_k512", "system_allbigrams", "system_selected", "system_pmi_k512"}


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


def rows(frame):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v != v or str(v) == "<NA>":
            return None
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) else v

    return sorted(repr([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_sql(spark, data, db, name):
    got = QUERIES[name](spark, data).toPandas()
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got[columns]) == rows(want[columns])


@pytest.mark.parametrize("name", ["compare3", "cross_lingual", "selection_sweep"])
def test_sweeps(spark, data, name):
    got = QUERIES[name](spark, data).collect()
    assert got and all(0 <= r["map"] <= 1 for r in got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_exact_p_values():
    """Of 11 pairs without ties: every choice of signs, one by one."""
    n = 11
    sums = [sum(r for r in range(1, n + 1) if signs >> (r - 1) & 1) for signs in range(1 << n)]
    for plus in (0, 7, 33, 50, 66):
        two, greater, _ = signif.p_values(n, n, plus, 0, 0.1)
        assert abs(greater - sum(s >= plus for s in sums) / 2**n) < 1e-12
        assert abs(two - min(1, 2 * min(sum(s >= plus for s in sums), sum(s <= plus for s in sums)) / 2**n)) < 1e-12
    assert signif.p_values(n, n, 50, 6, 0.1) != signif.p_values(n, n, 50, 0, 0.1)


def test_relevance_is_containment(spark, data, db):
    got = {tuple(r) for r in catalog.relevance(spark, data).collect()}
    assert got == set(db.sql("select b.item_id, d.doc_id from documents d join benchmark b on contains(d.text, b.text)").fetchall())
