"""Similar names against all pairs, components against a plain search."""

import random

import duckdb
import pytest


from tallyloom.operators import entities


def distance(a, b):
    return duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_no_pair_is_lost(spark, most):
    rng = random.Random(most)
    names = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(120)} | {"Công ty Đại Nam", "Cong ty Dai Nam", "é", "漢字漢字", "漢字字"}
    rows = [(i, rng.choice("xy") if n else "x", n) for i, n in enumerate(sorted(names))] + [(900, None, "ab"), (901, "x", None), (None, "x", "ab"), (902, "x", "ab"), (903, "x", "ab")]
    df = spark.createDataFrame(rows, "id long, block string, name string")
    kept = [(i, b, n) for i, b, n in rows if None not in (i, b, n)]
    values = ",".join("(?,?,?)" for _ in kept)
    expect = duckdb.execute(
        f"WITH r(i, b, n) AS (VALUES {values}) SELECT x.i, y.i, levenshtein(x.n, y.n) FROM r x JOIN r y ON x.b = y.b AND x.i < y.i WHERE levenshtein(x.n, y.n) <= {most}", [v for r in kept for v in r]
    ).fetchall()
    plain = {i for i, _, n in kept if n.isascii()}  # DuckDB counts bytes
    found = [(r.key_a, r.key_b, r.distance) for r in entities.candidates(df, df, "block", "name", "id", most).collect()]
    assert sorted(p for p in found if plain.issuperset(p[:2])) == sorted(p for p in expect if plain.issuperset(p[:2]))
    other = spark.createDataFrame([(1, "x", "漢字漢字"), (2, "x", "漢字字"), (3, "x", "")], "id long, block string, name string")
    assert [(r.key_a, r.key_b, r.distance) for r in entities.candidates(other, other, "block", "name", "id", most).collect() if r.key_b < 3] == ([(1, 2, 1)] if most else [])


def test_few_probes():
    assert [len(entities.probes(k)) for k in range(4)] == [1, 4, 12, 26]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(300, 340)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)] + [(1, 1)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = entities.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(found) == len(root) and {r.node: r.root for r in found} == {x: find(x) for x in root}
    assert entities.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_groups(spark):
    rows = [(1, "x", "acme"), (2, "x", "acme1"), (3, "x", "acme12"), (4, "x", "other"), (5, "y", "acme"), (6, "x", None), (7, None, "acme"), (8, "x", "acme")]
    out = entities.groups(spark.createDataFrame(rows, "id long, block string, name string"), "block", "name", 1)
    assert sorted(tuple(r)[:1] + tuple(r)[3:] for r in out.collect()) == [(1, "acme", 4), (2, "acme", 4), (3, "acme", 4), (4, "other", 1), (5, "acme", 1), (6, None, 0), (7, None, 0), (8, "acme", 4)]
