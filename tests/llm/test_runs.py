"""Periodic runs against a plain search over all periods."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from cases import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import periodic_runs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_runs(words):
    """Every maximal stretch of every period, the smallest period of each stretch."""
    least, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                least.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in least.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def same(df, rows):
    got = periodic_runs.run_report(periodic_runs.periodic_runs(df, loops=True))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    found, expect = sorted(map(tuple, got.collect()), key=key), sorted((expected(i, t) for i, t in rows), key=key)
    assert found == expect
    return found


small = st.lists(st.integers(0, 2), max_size=60)
looped = st.tuples(small, st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), small).map(lambda t: t[0] + t[1] * t[2] + t[3])


@settings(max_examples=600, deadline=None)
@given(st.one_of(small, looped, st.tuples(looped, looped).map(lambda t: t[0] + t[1] * 4)))
def test_runs_equal_a_plain_search(words):
    assert periodic_runs.find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_long_loops():
    rng = random.Random(2)
    unit = [rng.randrange(50) for _ in range(1111)]
    words = [7] * 3000 + unit * 6 + unit[:500] + [1, 2] * 2000 + list(range(3000)) + ([5] * 64 + [6]) * 40
    found = periodic_runs.find_runs(np.array(words, np.int64))
    assert (3000, 1111 * 6 + 500, 1111) in [(s + (3000 - s), length - (3000 - s), q) for s, length, q in found if q == 1111]
    assert {q for _, _, q in found} >= {1, 2, 65, 1111}
    assert found == plain_runs_of_periods(words, {q for _, _, q in found})


def plain_runs_of_periods(words, periods):
    out, n = {}, len(words)
    for q in sorted(periods):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def test_one_word_over_and_over_takes_no_square_time():
    ids = np.zeros(300_000, np.int64)
    assert periodic_runs.find_runs(ids) == [(0, 300_000, 1)]


def test_documents(spark):
    rng = random.Random(9)
    rows = documents()
    rows += [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(1000, 1300)]
    rows += [(2000 + i, ("x y z  " * 7 + "end ") * 5) for i in range(3)]
    found = same(frame(spark, rows), rows)
    assert sum(r[1] > 0 for r in found) > 100
    assert same(frame(spark, []), []) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if len(r.text or "") < 15_000]
    assert sum(r[1] > 0 for r in same(df.where("coalesce(length(text), 0) < 15000"), rows)) > 5
