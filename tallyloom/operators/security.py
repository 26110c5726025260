"""Row security as semi-joins: views that a member, an administrator or the owner may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_rows(rows: DataFrame, members: DataFrame, user: object, key: str, roles: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose organization (key) has the user as a member, in one of roles if any are given.

    members: (key, user_id, role). The user's memberships are few; whether they are
    broadcast is left to Spark's size check.
    """
    mine = members.where(F.col("user_id") == user)
    if roles:
        mine = mine.where(F.col("role").isin(*roles))
    return rows.join(mine.select(key), key, "left_semi")


def admin_rows(rows: DataFrame, members: DataFrame, user: object, key: str) -> DataFrame:
    return member_rows(rows, members, user, key, ("owner", "admin"))


def own_rows(rows: DataFrame, user: object, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == user)


def insertable_rows(batch: DataFrame, members: DataFrame, user: object, key: str, creator: str = "created_by") -> DataFrame:
    """Rows of a batch the user may insert: a member's, and created by the user."""
    return member_rows(batch.where(F.col(creator) == user), members, user, key)


#: (table, command) -> which of the rules above guards it; policies of one command add up.
POLICIES = {
    ("profiles", "select"): "own", ("profiles", "update"): "own",
    ("organizations", "select"): "member", ("organizations", "update"): "admin",
    ("organization_members", "select"): "member", ("organization_members", "all"): "admin",
    ("research_jobs", "select"): "member", ("research_jobs", "insert"): "insertable", ("research_jobs", "update"): "member",
    ("company_reports", "select"): "member", ("company_reports", "all"): "member",
    ("source_evidence", "select"): "member", ("source_evidence", "all"): "member",
    ("credit_ledger", "select"): "member",
}


def visible(rows: DataFrame, table: str, command: str, members: DataFrame, user: object, key: str, creator: str = "created_by") -> DataFrame:
    """The secured view of a table: rows that `command` by the user may touch. Without a policy none.

    Policies of one command add up, those for "all" commands count for each; an administrator is a
    member, so the widest of the rules decides.
    """
    rules = {POLICIES.get((table, command)), POLICIES.get((table, "all"))}
    if "own" in rules:
        return own_rows(rows, user, key)
    if "member" in rules:
        return member_rows(rows, members, user, key)
    if "admin" in rules:
        return admin_rows(rows, members, user, key)
    if "insertable" in rules:
        return insertable_rows(rows, members, user, key, creator)
    return rows.where(F.lit(False))


COMMANDS = ("select", "insert", "update", "delete")


def permissions(rows: DataFrame, members: DataFrame, user: object, key: str, creator: str = "created_by") -> DataFrame:
    """rows with policies, the list of "table command" that the user may apply to each if it is a row of that table.

    The same as visible() for every table and command, from one pass over rows: the user's memberships are made one
    row per organization, whether they are broadcast is left to Spark's size check.
    """
    mine = members.where(F.col("user_id") == user).groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.col("role").isin("owner", "admin")).alias("_admin"))
    seen = rows.join(mine, F.col(key) == F.col("_key"), "left")
    member = F.col("_key").isNotNull()
    holds = {
        "own": F.coalesce(F.col(key) == user, F.lit(False)), "member": member, "admin": member & F.coalesce("_admin", F.lit(False)),
        "insertable": member & F.coalesce(F.col(creator) == user, F.lit(False)),
    }
    tables = dict.fromkeys(t for t, _ in POLICIES)
    allowed = []
    for table in tables:
        for command in COMMANDS:
            rules = {POLICIES.get((table, command)), POLICIES.get((table, "all"))}
            rule = next((r for r in ("own", "member", "admin", "insertable") if r in rules), None)
            if rule:
                allowed.append(F.when(holds[rule], f"{table} {command}"))
    return seen.withColumn("policies", F.array_compact(F.array(*allowed))).drop("_key", "_admin")
