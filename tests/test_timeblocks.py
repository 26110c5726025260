"""Two-level running sums, previous rows, settings and field changes against plain loops; no task with a whole owner."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tallyloom.operators import history, ledger, reports, timeblocks

DAY = dt.datetime(2024, 1, 1)


def made(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):  # two thirds of the rows have one owner
        at = None if rng.random() < 0.02 else DAY + dt.timedelta(hours=rng.randrange(24 * 60))
        rows.append((rng.choice([7, 7, 7, 7, 1, None]), at, f"r{i:04d}", rng.choice([None, *range(-5, 6)]), rng.choice("abc")))
    return rows, spark.createDataFrame(rows, "owner long, at timestamp_ntz, id string, amount long, word string").repartition(5)


def by_owner(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or DAY, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sum(spark):
    rows, df = made(spark)
    found = {r.id: r.total for r in timeblocks.running_sum(df, "owner", ["at", "id"], F.col("amount"), "total").collect()}
    assert len(found) == len(rows)
    for mine in by_owner(rows).values():
        total = None
        for r in mine:
            total = r[3] if total is None else total + (r[3] or 0)
            assert found[r[2]] == total


def test_previous_and_changes(spark):
    rows, df = made(spark, seed=2)
    found = {r.id: r.before for r in timeblocks.previous(df, "owner", ["at", "id"], ["id", "word"], "before").collect()}
    changed = {r.id: r.previous for r in history.changes(df, "owner", "at", "id", "word", "day").collect()}
    for mine in by_owner(rows).values():
        assert found[mine[0][2]] is None and mine[0][2] not in changed
        for a, b in zip(mine, mine[1:]):
            assert tuple(found[b[2]]) == (a[2], a[4])
            assert (b[2] in changed) == (a[4] != b[4]) and changed.get(b[2], a[4]) == a[4]


def test_settings(spark):
    rng = random.Random(3)
    rows, df = made(spark, seed=3)
    settings = [(rng.choice([7, 1, 2, None]), DAY + dt.timedelta(hours=rng.randrange(24 * 60)), rng.choice([None, 30, 90, 365])) for _ in range(60)]
    found = {r.id: r.days for r in history.setting_at(df, spark.createDataFrame(settings, "owner long, since timestamp_ntz, days int"), "owner", "at", "since", "days", "day").collect()}
    assert len(found) == len(rows)
    for owner, at, key, *_ in rows:
        held = [(s, d) for o, s, d in settings if o == owner and d is not None and at is not None and s <= at]
        assert found[key] == (max(held)[1] if held else None)


def test_no_task_with_a_whole_owner(spark):
    n = 60_000
    df = spark.range(n).select(F.lit(7).cast("long").alias("owner"), (F.lit(DAY) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("at"), "id", F.lit("credit").alias("kind"), F.lit(1).alias("amount"))
    out = ledger.running(df, "owner", "kind", "amount", ["at", "id"])
    assert out.where("running_balance <> id + 1").isEmpty()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.7 * n


def test_newest_of_each(spark, capsys):
    rows, df = made(spark, seed=4)
    found = reports.newest_of_each(df, "owner", [F.desc("at"), F.col("id")])
    expect = []
    for mine in by_owner(rows).values():
        expect += [r[2] for r in sorted(mine, key=lambda r: (r[1] is None, -(r[1] or DAY).timestamp(), r[2]))[:4]]
    assert sorted(r.id for r in found.collect()) == sorted(expect)
    found.explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out
    assert {r.owner: r.id for r in history.latest(df, "owner", "at", "id").collect()} == {o: max(m, key=lambda r: (r[1] or DAY, [-ord(c) for c in r[2]]))[2] for o, m in by_owner(rows).items()}


def test_field_changes(spark):
    contact = "array<struct<label:string,value:string,verified:boolean>>"
    rows = [
        ("acme", DAY, "v1", "de", None, [("mail", "a@x", True), ("tel", "1", None), ("tel", "2", None)]),
        ("acme", DAY + dt.timedelta(60), "v2", "de", "x", [("tel", "1", None), ("tel", "3", None), ("fax", "9", False)]),
        ("acme", DAY + dt.timedelta(90), "v3", None, "x", None),
        ("other", DAY, "v4", "fr", "y", []),
    ]
    df = spark.createDataFrame(rows, f"company string, at timestamp_ntz, version string, country string, website string, contacts {contact}")
    found = history.field_changes(df, "company", "at", "version", ["country", "website"], {"contacts": ["label"]})
    assert found.columns == ["company", "at", "version", "field", "item", "change", "old", "new"]
    js = lambda *c: '{"label":"%s","value":"%s"%s}' % c
    expect = [
        ("v2", "website", None, "changed", None, "x"), ("v2", "contacts", '{"label":"mail"}', "removed", js("mail", "a@x", ',"verified":true'), None),
        ("v2", "contacts", '{"label":"tel"}', "changed", js("tel", "2", ""), js("tel", "3", "")), ("v2", "contacts", '{"label":"fax"}', "added", None, js("fax", "9", ',"verified":false')),
        ("v3", "country", None, "changed", "de", None), ("v3", "contacts", '{"label":"tel"}', "removed", js("tel", "1", ""), None),
        ("v3", "contacts", '{"label":"tel"}', "removed", js("tel", "3", ""), None), ("v3", "contacts", '{"label":"fax"}', "removed", js("fax", "9", ',"verified":false'), None),
    ]
    assert sorted(map(str, (tuple(r)[2:] for r in found.collect()))) == sorted(map(str, expect))


def exchanged(spark, df, capsys):
    """The columns of every shuffle of df's plan, one that is read again counted once."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("false", "-1")):
            spark.conf.set(k, v)
        df.explain("formatted")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\) Exchange\n(?:Output|Input) \[\d+\]: \[(.*?)\]\n", capsys.readouterr().out)]


def test_lists_are_shuffled_twice(spark, capsys):
    """Once with their rows and once, from that same shuffle, to the owner's next block; never as JSON or through the window over blocks."""
    contact = "array<struct<label:string,value:string>>"
    df = spark.createDataFrame([("acme", DAY, "v1", "de", [("mail", "a@x")])], f"company string, at timestamp_ntz, version string, country string, contacts {contact}")
    shuffles = exchanged(spark, history.field_changes(df, "company", "at", "version", ["country"], {"contacts": ["label"]}), capsys)
    wide = [x for x in shuffles if not x <= {"_owner", "_block", "_next"}]
    assert len(wide) == 2 and sum("contacts" in x for x in wide) == 1 and sum("_carry" in x for x in wide) == 1


def test_rows_are_shuffled_once(spark, capsys):
    """Windows and joins of running sums and settings are partitioned alike, also for null owners and times."""
    _, df = made(spark)
    df = df.localCheckpoint()
    sums = exchanged(spark, timeblocks.running_sum(df, "owner", ["at", "id"], F.col("amount"), "total"), capsys)
    assert sum("id" in x for x in sums) == 1
    since = df.select("owner", F.col("at").alias("since"), F.col("amount").alias("days"))
    held = exchanged(spark, timeblocks.last_value(df, since, "owner", "at", "since", "days"), capsys)
    assert sum("id" in x for x in held) == 1
