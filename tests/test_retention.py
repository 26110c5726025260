"""Purges of a store: rows, files and repeated runs."""

import datetime as dt
import os
import random

from tallyloom.operators import retention

NOW = dt.datetime(2024, 3, 10, 12)


def files_of(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                at = os.path.join(folder, n)
                out[os.path.relpath(at, path)] = os.stat(at).st_mtime_ns
    return out


def test_purge(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, None if i % 17 == 0 else NOW + dt.timedelta(hours=rng.randrange(-90, 90)), f"é{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, expires timestamp_ntz, text string")
    path = str(tmp_path / "reports")
    retention.store(df, path, "expires")
    before = files_of(path)
    done = retention.purge(spark, path, df.schema, "expires", NOW)
    assert done["rewritten"] == [NOW.date()] and done["dropped"] and max(done["dropped"]) < NOW.date()
    read = lambda: sorted(map(tuple, retention.read_store(spark, path, df.schema).collect()), key=str)
    assert read() == sorted((r for r in rows if r[1] is None or r[1] >= NOW), key=str)
    after = files_of(path)
    day = f"{retention.START}={NOW.date()}"
    assert {f: t for f, t in after.items() if not f.startswith(day)} == {f: t for f, t in before.items() if f in after and not f.startswith(day)}
    assert retention.purge(spark, path, df.schema, "expires", NOW) == {"dropped": [], "rewritten": []}
    assert files_of(path) == after
    end = NOW + dt.timedelta(days=30)
    retention.purge(spark, path, df.schema, "expires", end)
    assert {r[1] for r in read()} == {None}


def test_a_purge_cut_short_is_finished_by_the_next(spark, tmp_path):
    df = spark.createDataFrame([(i, NOW + dt.timedelta(days=i - 5)) for i in range(10)], "id long, expires timestamp_ntz")
    path = str(tmp_path / "cut")
    retention.store(df, path, "expires")
    retention.purge(spark, path, df.schema, "expires", NOW - dt.timedelta(days=3))  # as if it had stopped here
    retention.purge(spark, path, df.schema, "expires", NOW)
    assert sorted(r.id for r in retention.read_store(spark, path, df.schema).collect()) == [5, 6, 7, 8, 9]
    retention.purge(spark, path, df.schema, "expires", NOW + dt.timedelta(days=99))
    assert retention.read_store(spark, path, df.schema).count() == 0
    assert retention.purge(spark, str(tmp_path / "none"), df.schema, "expires", NOW) == {"dropped": [], "rewritten": []}


def test_evidence_goes_with_its_report(spark, tmp_path):
    hours = lambda h: None if h is None else NOW + dt.timedelta(hours=h)
    reports = spark.createDataFrame([(1, hours(-1)), (2, hours(5)), (3, None)], "report long, expires timestamp_ntz")
    given = [(1, 9, "a"), (2, 9, "b"), (2, -2, "c"), (3, 9, "d"), (4, -2, "e"), (4, 2, "f"), (None, None, "g")]
    evidence = spark.createDataFrame([(r, hours(h), n) for r, h, n in given], "report long, expires timestamp_ntz, name string")
    path = str(tmp_path / "evidence")
    out = retention.with_report(evidence, reports, "report", "expires")
    assert out.columns == evidence.columns
    retention.store(out, path, "expires")
    retention.purge(spark, path, out.schema, "expires", NOW)
    assert sorted(r.name for r in retention.read_store(spark, path, out.schema).collect()) == ["b", "d", "f", "g"]
    retention.store(spark.createDataFrame([(5, hours(9), "h")], out.schema), path, "expires")
    assert "h" in [r.name for r in retention.read_store(spark, path, out.schema).collect()]
