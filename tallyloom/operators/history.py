"""Snapshots: the latest, what changed, retention, schedules, similar companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import dates
from tallyloom.functions.urls import let
from tallyloom.operators import entities, timeblocks
from tallyloom.operators.reports import newest_of_each


def latest(snapshots: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """One row per key, the newest, of equally new ones the first by tie; kept to one per key in each task before the shuffle."""
    return newest_of_each(snapshots, key, [F.desc(at), F.asc(tie)], 1)


def changes(snapshots: DataFrame, key: str, at: str, tie: str, value: str, unit: str = "month") -> DataFrame:
    """Snapshots whose value differs from the one before it of the same key; see timeblocks for unit."""
    seen = timeblocks.previous(snapshots, key, [at, tie], [value], "_before", unit)
    differs = F.col("_before").isNotNull() & ~F.col(value).eqNullSafe(F.col(f"_before.{value}"))
    return seen.where(differs).withColumn("previous", F.col(f"_before.{value}")).drop("_before")


def _items(items: Column, by: list[str]) -> Column:
    """A list of structs as (key, number among those of one key, JSON)."""
    keyed = F.transform(items, lambda x: F.struct(F.to_json(F.struct(*(x[c].alias(c) for c in by))).alias("key"), F.to_json(x).alias("item")))
    number = lambda x, k, xs: F.size(F.filter(F.slice(xs, 1, k), lambda y: y["key"] == x["key"]))
    numbered = lambda xs: F.transform(xs, lambda x, k: F.struct(x["key"].alias("key"), number(x, k, xs).alias("number"), x["item"].alias("item")))
    return let(F.coalesce(keyed, F.array().cast("array<struct<key:string,item:string>>")), numbered)


def _change(field: str, item: Column | None, kind: str, old: Column | None, new: Column | None) -> Column:
    none = F.lit(None).cast("string")
    given = lambda c: none if c is None else c
    return F.struct(F.lit(field).alias("field"), given(item).alias("item"), F.lit(kind).alias("change"), given(old).alias("old"), given(new).alias("new"))


def _item_changes(field: str, old: Column, new: Column) -> list[Column]:
    same = lambda x, xs: F.get(F.filter(xs, lambda y: (y["key"] == x["key"]) & (y["number"] == x["number"])), F.lit(0))["item"]
    lost = lambda x: F.when(same(x, new).isNull(), _change(field, x["key"], "removed", x["item"], None))
    come = lambda x: F.when(same(x, old).isNull(), _change(field, x["key"], "added", None, x["item"])).when(
        same(x, old) != x["item"], _change(field, x["key"], "changed", same(x, old), x["item"])
    )
    return [F.transform(old, lost), F.transform(new, come)]


def field_changes(
    snapshots: DataFrame, key: str, at: str, tie: str, fields: list[str], lists: dict[str, list[str]] | None = None, unit: str = "month"
) -> DataFrame:
    """What each snapshot changed against the one before it of its key: (key, at, tie, field, item, change, old, new).

    fields: plain columns, compared as they are, a null being a value; old and new are texts. lists: columns of lists of
    structs, such as contacts or sources, with the fields by which an item is found again: item is that key as JSON, change
    is added, removed or changed, old and new are the items as JSON. Of items with one key the first is compared
    with the first, and so on. The first snapshot of a key changes nothing; a null list is an empty one.
    """
    lists = lists or {}
    names = [*fields, *lists]
    kept = snapshots.select(key, at, tie, *names)
    seen = timeblocks.previous(kept, key, [at, tie], names, "_before", unit).where("_before IS NOT NULL")
    # Items become JSON, which is several times as large, only after the last shuffle.
    made = {n: _items(F.col(c), by) for f, by in lists.items() for n, c in ((f, f), (f"_was_{f}", f"_before.{f}"))}
    seen = seen.withColumns(made) if made else seen
    old = lambda f: F.col(f"_before.{f}")
    plain = [F.when(~F.col(f).eqNullSafe(old(f)), _change(f, None, "changed", old(f).cast("string"), F.col(f).cast("string"))) for f in fields]
    found = [F.array(*plain)] if plain else []
    for f in lists:
        found += _item_changes(f, F.col(f"_was_{f}"), F.col(f))
    return seen.select(key, at, tie, F.inline(F.filter(F.concat(*found), lambda c: c.isNotNull())))


def split_expired(rows: DataFrame, expires: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(keep, purge); rows without an expiry stay."""
    gone = F.coalesce(dates.is_expired(F.col(expires), as_of), F.lit(False))
    return rows.where(~gone), rows.where(gone)


def lifecycle_counts(rows: DataFrame, expires: str, archived: Column, as_of: Column, days: int = 29) -> DataFrame:
    """active, expiring, archived in one pass."""
    at = F.col(expires)
    return rows.agg(
        F.count_if(~archived & (at >= as_of)).alias("active"),
        F.count_if(~archived & dates.is_expiring(at, as_of, days)).alias("expiring"),
        F.count_if(archived).alias("archived"),
    )


def schedule(jobs: DataFrame, start: Column, end: Column, every: Column) -> DataFrame:
    """One row per due date: start, start + every days, ... up to end."""
    return jobs.withColumn("due", F.explode(F.sequence(start, end, F.make_dt_interval(every))))


def mark_expired(rows: DataFrame, status: str, expires: str, as_of: Column) -> DataFrame:
    """Rows past their expiry get the status "expired"; they stay."""
    gone = F.coalesce(dates.is_expired(F.col(expires), as_of), F.lit(False))
    return rows.withColumn(status, F.when(gone, "expired").otherwise(F.col(status)))


def current(rows: DataFrame, status: str) -> DataFrame:
    """What may be shown as current: no expired row."""
    return rows.where(~F.col(status).eqNullSafe(F.lit("expired")))


def setting_at(rows: DataFrame, settings: DataFrame, key: str, at: str, since: str, value: str, unit: str = "month") -> DataFrame:
    """Each row with the setting of its key that held at its time, so that a later change binds new rows only.

    settings: (key, since, value). Rows before the first setting get null. The last setting is carried across blocks
    of time (unit), so that a key's rows spread over tasks.
    """
    return timeblocks.last_value(rows, settings, key, at, since, value, unit)


def candidates(left: DataFrame, right: DataFrame, block: str, name: str, key: str, most: int) -> DataFrame:
    """Pairs of one block whose names are within `most` edits; each pair once, by key."""
    return entities.candidates(left, right, block, name, key, most)
