"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import os
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest

from tallyloom.llm import conversation_repair as repair

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
GOOD = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying, turn by turn, every edit and every insert (two in a row are never cheaper)."""
    faults = faults_of(rows)

    def grammar(state, initial):  # state of s?(ua)+ after one more initial, None where it leaves the grammar
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @cache
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            for role in ("user", "assistant"):
                to = grammar(state, role[0])
                if to:
                    c, a, t = best(i, to, inserts + 1)
                    options.append((c + 2, "I" + a, ((role, ""), *t)))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            c, a, t = best(i + 1, state, 0)
            options.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                for edit, price, to_role in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    to = grammar(state, to_role[:1])
                    if to:
                        c, a, t = best(i + 1, to, 0)
                        options.append((c + price + (fault == "truncated"), edit + a, ((to_role, text), *t)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(conv_id, turns):
    rows = []
    given = lambda v: " " if v is None else str(v)
    for turn, role, text in turns:
        role, text = given(role), given(text)
        what = zlib.crc32(f"{given(conv_id)}:{given(turn)}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        both = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        rows += [((turn is not None, turn or 0), role, both, turn, text)] * (2 if what == 3 else 1)
    rows.sort(key=lambda r: r[:3])
    said = [(r[1], r[4]) for r in rows]
    cost, audit, left = cheapest(tuple(said))
    assert GOOD.fullmatch("".join(r[0] for r, _ in left))
    at = [r[3] for r in rows if r[3] is not None]
    faults, pairs = faults_of(said), list(zip((r[:1] for r, _ in said), (r[:1] for r, _ in said[1:])))
    joined = "\n".join(f"{r}:{t}" for r, t in left)
    return (
        conv_id, max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256(joined.encode()).hexdigest(),
    )


def check(spark, rows, df=None):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn, role, text))
    df = df or spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, view string, digest string")
    got = repair.repair_verdicts(df)
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert got.columns == names
    key = lambda r: (r[0] is None, r[0] or 0)
    found = sorted((tuple(r) for r in got.collect()), key=key)
    assert found == sorted((expected(c, t) for c, t in by.items()), key=key)
    return found


def test_repair_against_every_edit(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(400):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "User", "", None, "u"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(["Yes.", "No", " \t", "", "Why?\n", "So on… ", "é."]) + str(rng.choice(["", "", turn, "."])) if rng.random() < 0.9 else None))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, None, None)]
    found = check(spark, rows)
    assert len({f[7] for f in found}) > 150 and any(f[7] == "" for f in found)


def test_long_and_empty_conversations(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"turn {k}" + rng.choice([".", ".", ""])) for k in range(300)]
    rows += [(8, 0, "user", "word " * 200_000 + "."), (8, 1, "assistant", "x.")]
    gone = next(c for c in range(9, 10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    check(spark, rows + [(gone, 0, "user", "never seen.")])
    assert check(spark, [], spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == []


def test_edits_rebuild_the_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hm."), (1, 1, "user", "So?"), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    damaged = repair.damage(df)
    edits = [(r.step, r.edit, r.role, r.text) for r in repair.repair(damaged).collect()]
    assert edits[0][:2] == (0, None) and [e[0] for e in edits] == list(range(len(edits)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert check(spark, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], df)


def test_plan_prefers_what_the_audit_says():
    for initials in product((repair.START, repair.SYSTEM, repair.USER, repair.ASSISTANT), repeat=5):
        names = [("tool", "system", "user", "assistant")[i] for i in initials]
        cost, audit, _ = cheapest(tuple((r, f"{k}.") for k, r in enumerate(names)))
        assert repair.plan(bytes(initials), bytes(5))[0] == cost
