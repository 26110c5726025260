"""Every query of the library against the SQL that DuckDB runs on the same tables."""

import math
import os

import duckdb
import pytest

from tallyloom.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    expect = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(expect.columns) == cols
    at = [expect.columns.index(c) for c in cols]
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in expect.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_slugs_of_whole_texts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    slugs = {r.doc_id: r.slug for r in plans.QUERIES["slugify"](spark, SF).collect()}
    assert slugs.keys() == text.keys()
    for i, t in text.items():  # words of every line, the last too
        if t and t.isascii():
            assert slugs[i] == "-".join("".join(c if c.isalnum() else " " for c in t.lower()).split())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_summaries_end_with_sources_and_snapshot(spark):
    rows = plans.QUERIES["clipboard_summary_whole"](spark, SF).collect()
    assert rows
    for r in rows:
        *_, heading, website, search, snapshot = r.summary.split("\n")
        assert heading == "SOURCES:" and "://" in website and "/search?q=" in search and snapshot.startswith("Snapshot: ")


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLE_SQL.keys()


def test_top_k_and_pushdown(spark, capsys):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plans.QUERIES["recent_top4"](spark, SF).explain("formatted")
    assert "TakeOrderedAndProject" in capsys.readouterr().out
    plans.QUERIES["rls_self"](spark, SF).explain("formatted")
    assert "EqualTo(c_custkey" in capsys.readouterr().out
