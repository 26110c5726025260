"""Deletes through the reference graph against a row-by-row simulation."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import keygraph
from tallyloom.operators.keygraph import CASCADE, REFERENCES, RESTRICT, SET_NULL, Reference

COLUMNS = {
    "users": ["id"], "organizations": ["id"], "profiles": ["id"], "organization_members": ["organization_id", "user_id"],
    "research_jobs": ["id", "organization_id", "created_by"], "company_reports": ["id", "organization_id", "research_job_id"],
    "source_evidence": ["id", "organization_id", "company_report_id"], "credit_ledger": ["id", "organization_id", "created_by", "research_job_id"],
}


def simulate(tables, table, keys, references=REFERENCES):
    """One statement a key; rows are dicts."""
    refused = set()
    for k in sorted({k for k in keys if any(r["id"] == k for r in tables[table])}):
        dead, todo, stop = {(table, id(r)) for r in tables[table] if r["id"] == k}, [(table, r) for r in tables[table] if r["id"] == k], False
        while todo:
            name, row = todo.pop()
            for ref in references:
                if ref.parent == name:
                    for child in tables[ref.child]:
                        if child[ref.column] is not None and child[ref.column] == row["id"]:
                            stop |= ref.action == RESTRICT
                            if ref.action == CASCADE and (ref.child, id(child)) not in dead:
                                dead.add((ref.child, id(child)))
                                todo.append((ref.child, child))
        if stop:
            refused.add(k)
    good = [k for k in keys if k not in refused]
    dead, todo = set(), [(table, r) for r in tables[table] if r["id"] in good]
    dead |= {(table, id(r)) for _, r in todo}
    gone = {(table, r["id"]) for _, r in todo}
    while todo:
        name, row = todo.pop()
        for ref in references:
            if ref.parent == name and ref.action == CASCADE:
                for child in tables[ref.child]:
                    if child[ref.column] is not None and child[ref.column] == row["id"] and (ref.child, id(child)) not in dead:
                        dead.add((ref.child, id(child)))
                        gone.add((ref.child, child.get("id")))
                        todo.append((ref.child, child))
    after = {n: [dict(r) for r in rows if (n, id(r)) not in dead] for n, rows in tables.items()}
    for ref in references:
        if ref.action == SET_NULL:
            for r in after[ref.child]:
                r[ref.column] = None if (ref.parent, r[ref.column]) in gone else r[ref.column]
    return after, refused


def made(rng):
    some = lambda n, top: [rng.choice([None, *range(top)]) for _ in range(n)]
    t = {"users": [{"id": i} for i in range(8)], "organizations": [{"id": i} for i in range(5)], "profiles": [{"id": i} for i in range(6)]}
    for name, n in (("organization_members", 12), ("research_jobs", 7), ("company_reports", 8), ("source_evidence", 14), ("credit_ledger", 12)):
        tops = {"organization_id": 5, "user_id": 8, "created_by": 8, "research_job_id": 7, "company_report_id": 8}
        t[name] = [dict(zip(COLUMNS[name], [i if c == "id" else some(1, tops[c])[0] for c in COLUMNS[name]])) for i in range(n)]
    return t


@pytest.mark.parametrize("seed,table", [(1, "organizations"), (2, "users"), (3, "research_jobs"), (4, "users")])
def test_the_whole_graph(spark, seed, table):
    rng = random.Random(seed)
    rows = made(rng)
    keys = [rng.randrange(12) for _ in range(4)] + [None]
    frames = {n: spark.createDataFrame([tuple(r[c] for c in COLUMNS[n]) for r in rs], ", ".join(f"{c} long" for c in COLUMNS[n])) for n, rs in rows.items()}
    done = keygraph.delete(frames, table, spark.createDataFrame([(k,) for k in keys], "id long"))
    after, refused = simulate(rows, table, keys)
    assert {r.id for r in done.refused.collect()} == refused
    text = lambda r: tuple(str(v) for v in r)
    for n in rows:
        assert sorted(map(text, done.tables[n].select(*COLUMNS[n]).collect())) == sorted(text(tuple(r[c] for c in COLUMNS[n])) for r in after[n]), n
        if n in done.gone:
            assert done.gone[n].count() == len(rows[n]) - len(after[n])


def test_order_and_cycles():
    order = keygraph.order_of(REFERENCES)
    assert all(order.index(r.parent) < order.index(r.child) for r in REFERENCES)
    with pytest.raises(ValueError):
        keygraph.order_of([Reference("a", "x", "b", CASCADE), Reference("b", "y", "a", CASCADE)])


def test_a_hot_parent_and_empty_tables(spark):
    refs = [Reference("child", "p", "parent", CASCADE), Reference("grand", "c", "child", SET_NULL)]
    parent = spark.range(3)
    child = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(1).cast("long").alias("p"))
    grand = spark.range(1000).select("id", (F.col("id") * 30).alias("c"))
    done = keygraph.delete({"parent": parent, "child": child, "grand": grand}, "parent", spark.createDataFrame([(0,)], "id long"), refs)
    assert done.tables["child"].count() == 20_000 and done.tables["grand"].where("c is null").count() == 1000
    none = keygraph.delete({"parent": parent.limit(0), "child": child.limit(0), "grand": grand}, "parent", spark.createDataFrame([(0,)], "id long"), refs)
    assert none.tables["grand"].where("c is null").count() == 0 and none.refused.count() == 0
