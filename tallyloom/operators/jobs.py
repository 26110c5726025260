"""Research jobs as a log: states and credits from a job's events, folded in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.constraints import STATUSES

#: Fixed values: (event, state it may come in) -> the state after it. Credits are held while a job is open,
#: charged once a report is there, given back when it failed.
MOVES = {
    ("reserve", "queued"): "queued", ("start", "queued"): "researching", ("succeed", "researching"): "ready", ("review", "researching"): "needs_review",
    ("succeed", "needs_review"): "ready", ("fail", "queued"): "failed", ("fail", "researching"): "failed", ("fail", "needs_review"): "failed",
    ("settle", "ready"): "ready", ("refund", "failed"): "failed", ("retry", "failed"): "queued", ("refresh", "ready"): "queued", ("refresh", "expired"): "queued",
    ("expire", "ready"): "expired", ("expire", "needs_review"): "expired",
}
FIRST = "queued"
#: What an event's amount adds to the credits held and to those charged.
HELD = {"reserve": 1, "settle": -1, "refund": -1}
CHARGED = {"settle": 1}


def _map(pairs: dict, kind: str) -> Column:
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.lit(v).cast(kind))))


def once(events: DataFrame, job: str, order: list[str], reference: str) -> DataFrame:
    """events without those whose external reference an earlier event of the job has; without a reference an event counts."""
    given = events.where(F.col(reference).isNotNull())
    first = given.groupBy(F.col(job).alias("_job"), F.col(reference).alias("_reference")).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.col(job).eqNullSafe(F.col("_job")) & (F.col(reference) == F.col("_reference"))
    kept = given.join(first, same, "left").where(F.struct(*order) == F.col("_first")).drop("_job", "_reference", "_first")
    return events.where(F.col(reference).isNull()).unionByName(kept)


def _step(path: Column, event: Column) -> Column:
    """One event on a path (from, state, refused, held, charged): an illegal one is refused and changes nothing else."""
    key = F.concat_ws("|", event["kind"], path["state"])
    to = F.try_element_at(_map({f"{k}|{s}": v for (k, s), v in MOVES.items()}, "string"), key)
    moved = lambda signs: F.when(to.isNotNull(), F.coalesce(F.try_element_at(_map(signs, "long"), event["kind"]) * event["amount"], F.lit(0))).otherwise(0).cast("long")
    return F.struct(
        path["from"].alias("from"), F.coalesce(to, path["state"]).alias("state"), (path["refused"] + F.when(to.isNull(), 1).otherwise(0)).cast("long").alias("refused"),
        (path["held"] + moved(HELD)).cast("long").alias("held"), (path["charged"] + moved(CHARGED)).cast("long").alias("charged"),
    )


def _then(path: Column, block: Column) -> Column:
    """A path, and after it a block's path from the state where it ended."""
    part = F.get(F.filter(block, lambda p: p["from"] == path["state"]), F.lit(0))
    add = lambda c: (path[c] + part[c]).alias(c)
    return F.struct(path["from"].alias("from"), part["state"].alias("state"), add("refused"), add("held"), add("charged"))


def _start(state: str) -> Column:
    zero = lambda c: F.lit(0).cast("long").alias(c)
    return F.struct(F.lit(state).alias("from"), F.lit(state).alias("state"), zero("refused"), zero("held"), zero("charged"))


def fold(events: DataFrame, job: str, order: list[str], kind: str, amount: str, reference: str | None = None, unit: str = "day") -> DataFrame:
    """(job, state, reserved, charged, refused) of every job, from its events by order, whose first column is a time.

    A job starts as queued. An event that its state does not allow is refused and counted; unknown kinds are refused too,
    a null amount is 0. With a reference an event counts once, the first time; one that was refused is not tried again.
    The order should tell a job's events apart.

    Events are folded within blocks of time (unit) first, from every state a block may start in; one row per
    block is then folded over the job. So a job's log is spread over tasks, and no group is larger than a block's events
    or a job's blocks.
    """
    counted = once(events, job, order, reference) if reference else events
    block = F.date_trunc(unit, F.col(order[0]).cast("timestamp"))
    event = F.struct(F.struct(*order).alias("order"), F.col(kind).alias("kind"), F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("amount"))
    listed = counted.groupBy(F.col(job).alias("_job"), block.alias("_block")).agg(F.array_sort(F.collect_list(event)).alias("_events"))
    every = F.array(*map(_start, STATUSES))
    paths = F.reduce("_events", every, lambda all_, e: F.transform(all_, lambda p: _step(p, e)))
    blocks = listed.select("_job", F.struct("_block", paths.alias("paths")).alias("_part"))
    done = blocks.groupBy("_job").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    end = F.reduce("_parts", _start(FIRST), lambda path, b: _then(path, b["paths"]))
    return done.select(F.col("_job").alias(job), end.alias("_end")).select(
        job, F.col("_end.state").alias("state"), F.col("_end.held").alias("reserved"), F.col("_end.charged").alias("charged"), F.col("_end.refused").alias("refused")
    )
