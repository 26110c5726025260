"""Expiry, retention and schedules; the time of reference is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days until a report expires; days kept by plan choice.
RETENTION_DAYS, PLAN_DAYS = 30, (30, 90, 365)


def expiry_date(day: Column, days: int = RETENTION_DAYS) -> Column:
    return F.date_add(day.cast("date"), days)


def short_date(day: Column) -> Column:
    return F.date_format(day, "d/M/yyyy")


def days_left(expires: Column, as_of: Column) -> Column:
    return F.datediff(expires, as_of)


def report_id(created: Column) -> Column:
    return F.concat(F.lit("report-"), F.unix_millis(created).cast("string"))


def effective_retention(plan_days: Column, source_days: Column) -> Column:
    """Bounded by the plan and by the source's terms; a missing bound does not bind."""
    return F.least(plan_days, source_days)


def is_expired(expires: Column, as_of: Column) -> Column:
    return expires < as_of


def is_expiring(expires: Column, as_of: Column, days: int = 29) -> Column:
    """Within the next days, both ends counted."""
    return expires.between(as_of, as_of + F.make_dt_interval(F.lit(days)))
