import hashlib
import re

import pytest
from cases import documents, frame

from tallyloom.llm import exact_dedup as module
from tallyloom.llm.common import fresh_path
from tallyloom.llm.exact_dedup import exact_dedup, keep_first


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        g = groups[t]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), hashlib.sha256(t.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("bits", [256, 4])  # 4: most digests collide, so texts decide
def test_against_brute_force(spark, bits):
    rows = documents()
    got = exact_dedup(spark, frame(spark, rows), digest_bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_first_keeps_columns(spark):
    df = frame(spark, documents())
    out = keep_first(spark, df)
    assert out.columns == df.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in documents()})


def test_empty(spark):
    assert exact_dedup(spark, frame(spark, [])).collect() == []
    assert keep_first(spark, frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    exact_dedup(spark, frame(spark, documents())).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_a_column_named_metadata(spark):
    df = frame(spark, documents()).withColumnRenamed("lang", "_metadata")
    assert exact_dedup(spark, df).count() == df.count()
    assert keep_first(spark, df).columns == df.columns
    path = fresh_path(spark, "docs")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    assert keep_first(spark, stored).columns == df.columns
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup(spark, stored.where("doc_id >= 0")).collect()) == sorted(
        (r.doc_id, r.keep_id) for r in exact_dedup(spark, df.where("doc_id >= 0")).collect()
    )


@pytest.mark.parametrize("bits", [256, 4])
def test_a_second_arrival_meets_the_first(spark, bits):
    state = fresh_path(spark, "state")
    first, second = [(10, "a b"), (11, "c"), (12, "c"), (13, None)], [(1, "a  b"), (2, "d"), (3, "d "), (4, "c"), (None, ""), (5, "e"), (6, "e")]
    frame(spark, first).write.parquet(fresh := fresh_path(spark, "docs"))
    got = exact_dedup(spark, spark.read.parquet(fresh), digest_bits=bits, state=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(10, 10, 1, True), (11, 11, 2, True), (12, 11, 2, False), (13, 13, 1, True)]
    got = exact_dedup(spark, frame(spark, second), digest_bits=bits, state=state).collect()
    expect = [(1, 10, 2, False), (2, 2, 1, True), (3, 3, 1, True), (4, 11, 3, False), (None, 13, 2, False), (5, 5, 2, True), (6, 5, 2, False)]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == set(expect)
    third = exact_dedup(spark, frame(spark, [(0, "d"), (7, "a\tb")]), digest_bits=bits, state=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in third} == {(0, 2, 2, False), (7, 10, 3, False)}
    assert exact_dedup(spark, frame(spark, []), digest_bits=bits, state=state).collect() == []


def test_a_hot_digest_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT", 5)
    rows = documents() + [(3000 + k, "copied  text") for k in range(40)]
    got = exact_dedup(spark, frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
