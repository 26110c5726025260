"""The fold over a job's log against a loop."""

import datetime as dt
import random

from tallyloom.operators import jobs

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "job string, at timestamp_ntz, id long, kind string, amount int, reference string"


def loop(events):
    out = {}
    for job, _, _, kind, amount, reference in sorted(events, key=lambda e: (e[0] or "", e[1], e[2])):
        state = out.setdefault(job, {"state": "queued", "reserved": 0, "charged": 0, "refused": 0, "seen": set()})
        if reference is not None and reference in state["seen"]:
            continue
        state["seen"].add(reference)
        to = jobs.MOVES.get((kind, state["state"]))
        if to is None:
            state["refused"] += 1
            continue
        state["state"] = to
        state["reserved"] += {"reserve": 1, "settle": -1, "refund": -1}.get(kind, 0) * (amount or 0)
        state["charged"] += (amount or 0) if kind == "settle" else 0
    return {j: (s["state"], s["reserved"], s["charged"], s["refused"]) for j, s in out.items()}


def folded(spark, events, **how):
    df = spark.createDataFrame(events, SCHEMA).repartition(4)
    return {r.job: tuple(r)[1:] for r in jobs.fold(df, "job", ["at", "id"], "kind", "amount", "reference", **how).collect()}


def test_a_life(spark):
    at = lambda h: DAY + dt.timedelta(hours=h)
    life = [("a", at(0), 0, "reserve", 5, "r1"), ("a", at(1), 1, "reserve", 5, "r1"), ("a", at(2), 2, "settle", 5, "s1"), ("a", at(3), 3, "start", None, None), ("a", at(30), 4, "succeed", None, None), ("a", at(31), 5, "settle", 5, "s2"), ("a", at(60), 6, "settle", 5, "s2"), ("a", at(90), 7, "expire", None, None)]
    failed = [("b", at(0), 0, "reserve", 3, None), ("b", at(1), 1, "fail", None, None), ("b", at(50), 2, "refund", 3, "x"), ("b", at(51), 3, "refund", 3, "x"), ("b", at(52), 4, "unknown", None, None)]
    assert folded(spark, life + failed) == {"a": ("expired", 0, 5, 1), "b": ("failed", 0, 0, 1)}
    assert folded(spark, []) == {}


def test_against_a_loop(spark):
    rng = random.Random(1)
    kinds = sorted({k for k, _ in jobs.MOVES}) + ["odd", None]
    events = [
        (rng.choice(["hot", "hot", "hot", "b", "c", None]), DAY + dt.timedelta(hours=rng.randrange(300)), i, rng.choice(kinds), rng.choice([None, 1, 5]), rng.choice([None, None, f"x{rng.randrange(40)}"]))
        for i in range(1200)
    ]
    expect = loop(events)
    assert folded(spark, events) == folded(spark, events, unit="month") == folded(spark, events, unit="hour") == expect
    assert expect["hot"][3] > 100 and expect["hot"][2] > 0
