"""Declared constraints as violation queries; a null passes a check, as in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domains of the relational model.
PLANS = ("starter", "pro", "team", "enterprise")
STATUSES = ("queued", "researching", "ready", "needs_review", "failed", "expired")
SOURCE_KINDS = ("website", "directory", "social", "news", "registry", "customer_input")
LEDGER_TYPES = ("credit", "debit", "refund", "adjustment")
ROLES = ("owner", "admin", "member", "viewer")
DOMAINS = {"plan": PLANS, "status": STATUSES, "kind": SOURCE_KINDS, "type": LEDGER_TYPES, "role": ROLES}


def in_domains(columns: dict[str, str]) -> dict[str, Column]:
    """Checks for violations(): column -> the name of its domain."""
    return {f"{c} in {d}": one_of(F.col(c), DOMAINS[d]) for c, d in columns.items()}


def not_negative(value: Column) -> Column:
    return value >= 0


def in_range(value: Column, low: int, high: int) -> Column:
    return value.between(low, high)


def positive(value: Column) -> Column:
    return value > 0


def one_of(value: Column, domain: tuple[str, ...]) -> Column:
    return value.isin(*domain)


def any_given(*values: Column) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | v.isNotNull()
    return out


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows that fail each check, in one pass."""
    counts = rows.agg(*(F.count_if(~check).alias(name) for name, check in checks.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in checks))))


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    return violations(rows, {c: F.col(c).isNotNull() for c in columns})


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is given but has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows; keys with a null do not clash."""
    given = rows.where(F.concat(*(F.col(k).isNotNull().cast("string") for k in keys)) == "true" * len(keys))
    return given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tenant_mismatch(reports: DataFrame, jobs: DataFrame, job_key: str, tenant: str) -> DataFrame:
    """Reports whose organization is not their job's."""
    owner = jobs.select(job_key, F.col(tenant).alias("job_tenant"))
    return reports.join(owner, job_key).where(~F.col(tenant).eqNullSafe(F.col("job_tenant")))
