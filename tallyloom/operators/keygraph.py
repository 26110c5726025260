"""Deletes through all references of a schema: cascades, refusals and nulls together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, RESTRICT, SET_NULL = "cascade", "restrict", "set null"


@dataclass(frozen=True)
class Reference:
    """child.column names a row of parent by its key; what becomes of the child when that row is deleted."""

    child: str
    column: str
    parent: str
    action: str
    key: str = "id"


#: The references of the relational model.
REFERENCES = (
    Reference("profiles", "id", "users", CASCADE),
    Reference("organization_members", "organization_id", "organizations", CASCADE),
    Reference("organization_members", "user_id", "users", CASCADE),
    Reference("research_jobs", "organization_id", "organizations", CASCADE),
    Reference("research_jobs", "created_by", "users", RESTRICT),
    Reference("company_reports", "organization_id", "organizations", CASCADE),
    Reference("company_reports", "research_job_id", "research_jobs", CASCADE),
    Reference("source_evidence", "organization_id", "organizations", CASCADE),
    Reference("source_evidence", "company_report_id", "company_reports", CASCADE),
    Reference("credit_ledger", "organization_id", "organizations", CASCADE),
    Reference("credit_ledger", "created_by", "users", SET_NULL),
    Reference("credit_ledger", "research_job_id", "research_jobs", SET_NULL),
)


@dataclass
class Deletion:
    """tables: every table of the graph after the delete; refused: the roots that had to stay; gone: table -> deleted rows."""

    tables: dict[str, DataFrame]
    refused: DataFrame
    gone: dict[str, DataFrame]


def order_of(references) -> list[str]:
    """Tables, each after those it refers to. A cycle is an error."""
    graph = TopologicalSorter()
    for r in references:
        graph.add(r.child, r.parent)
    return list(graph.static_order())


def _named(keys: DataFrame, source: str, name: str) -> DataFrame:
    return keys.select(F.col(source).alias(name)).distinct()


def refused_roots(tables: dict[str, DataFrame], table: str, keys: DataFrame, references=REFERENCES) -> DataFrame:
    """Roots (their key) from which cascades reach a row that a restricting reference names.

    Rows are followed with the root they were reached from, along those cascades only that lead to a restricted table.
    """
    restricted = {r.parent for r in references if r.action == RESTRICT}
    leads = set(restricted)
    for name in reversed(order_of(references)):
        leads |= {r.parent for r in references if r.action == CASCADE and r.child == name and name in leads}
    key = keys.columns[0]
    reached = {table: keys.select(F.col(key).alias("_root"), *(F.col(k).alias(k) for k in keys.columns))} if table in leads else {}
    held = []
    for name in order_of(references):
        if name not in leads:
            continue
        found = [reached[name]] if name in reached else []
        for r in references:
            if r.child == name and r.action == CASCADE and r.parent in reached:
                roots = reached[r.parent].select("_root", F.col(r.key).alias("_parent")).distinct()
                found.append(tables[name].join(roots, F.col(r.column) == F.col("_parent")).drop("_parent").select("_root", *tables[name].columns))
        if not found:
            continue
        reached[name] = found[0] if len(found) == 1 and name != table else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        for r in references:
            if r.parent == name and r.action == RESTRICT:
                used = _named(tables[r.child], r.column, "_used")
                held.append(reached[name].join(used, F.col(r.key) == F.col("_used"), "left_semi").select(F.col("_root").alias(key)))
    return reduce(DataFrame.union, held).distinct() if held else keys.select(key).limit(0)


def delete(tables: dict[str, DataFrame], table: str, keys: DataFrame, references=REFERENCES) -> Deletion:
    """Delete the rows of a table whose key is in `keys` (one column, named as the key), as one statement for each key.

    A key is refused, with all it would have deleted, if a restricting reference names any row that its cascades
    reach, be that row's referrer deleted too or not. For the others rows of child tables go with their parents, in the
    order of the references, and references that are set to null lose their value in the rows that stay. Keys that are
    null or name no row delete nothing; a null reference follows nobody. Joins are by equal keys with the side of
    deleted keys made distinct; Spark broadcasts that side where it is small and splits skewed keys otherwise.
    """
    key = keys.columns[0]
    roots = tables[table].join(_named(keys, key, "_key"), F.col(key) == F.col("_key"), "left_semi")
    refused = refused_roots(tables, table, roots.select(key, *(c for c in roots.columns if c != key)), references)
    gone = {table: roots.join(_named(refused, key, "_key"), F.col(key) == F.col("_key"), "left_anti")}
    after = dict(tables)
    after[table] = tables[table].join(_named(gone[table], key, "_key"), F.col(key) == F.col("_key"), "left_anti")
    for name in order_of(references):
        for r in (r for r in references if r.child == name and r.parent in gone):
            dead = _named(gone[r.parent], r.key, "_dead")
            hit = F.col(r.column) == F.col("_dead")
            if r.action == CASCADE:
                lost = after[name].join(dead, hit, "left_semi")
                gone[name] = gone[name].unionByName(lost) if name in gone else lost
                after[name] = after[name].join(dead, hit, "left_anti")
        for r in (r for r in references if r.child == name and r.parent in gone and r.action == SET_NULL):
            dead = _named(gone[r.parent], r.key, "_dead")
            kept = after[name].join(dead, F.col(r.column) == F.col("_dead"), "left")
            after[name] = kept.withColumn(r.column, F.when(F.col("_dead").isNull(), F.col(r.column))).drop("_dead")
    return Deletion(after, refused, gone)
