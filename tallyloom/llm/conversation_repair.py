"""Repair of damaged conversations (operator 13).

The rows of a conversation are sorted by turn and streamed through a dynamic program over
the turns that stay. A turn stays as it is (K) or with another role (R); between two turns
that stay the others are deleted (D), which prefix sums price, and the pair of their roles
says how many turns are inserted (I). A running minimum per role over the turns to the
right makes a step constant work. Of equally cheap repairs the ASCII-least audit wins: as
D < I < K < R, that is the one that goes to the latest turn, then inserts, then keeps.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACE = " \t\n\u000b\f\r"
ROLES = ("", "system", "user", "assistant")
#: States: before any turn, after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns to insert between two states, the states that may follow, and those to insert at the end.
BETWEEN = {
    START: {SYSTEM: (), USER: (), ASSISTANT: (USER,)},
    SYSTEM: {USER: (), ASSISTANT: (USER,)},
    USER: {ASSISTANT: (), USER: (ASSISTANT,)},
    ASSISTANT: {USER: (), ASSISTANT: (USER,)},
}
AT_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
EDITS = f"step long, edit string, role string, text string, {COUNTS}"
FIGURES = f"{COUNTS}, audit string, repaired_sha256 string"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone, copies): the rows with the faults that a checksum of `conv_id:turn` deals out.

    gone marks dropped rows, copies is 2 for repeated ones. A null role or text is one space, so is a null in the checksum's text.
    """
    given = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    what = F.crc32(F.concat(given(conv_col), F.lit(":"), given(turn_col)).cast("binary")) % 20
    role, text = given(role_col), given(text_col)
    return turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"), F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (what == 0).alias("gone"), F.when(what == 3, 2).otherwise(1).alias("copies"),
    )


def plan(initials: bytes, faults: bytes) -> tuple[int, list[tuple[int, int]]]:
    """The cheapest repair: its cost and the turns that stay, as (number, state).

    initials: each turn's role as a state, START for any other role. faults: each turn's first fault.
    """
    n = len(initials)
    go_on = {s: array("q", bytes(8 * (n + 1))) for s in BETWEEN}  # cost of all after a turn that stays in that state
    then = {s: array("q", bytes(8 * (n + 1))) for s in BETWEEN}  # the next turn that stays times 4, plus its state
    cheapest: dict[int, tuple[int, int, bool]] = {}  # state -> prefix deletions + cost from that turn on, turn, rerole

    def after(i: int, state: int) -> tuple[int, int]:
        """Cheapest way from turn i on, the state before it given."""
        best = (DELETE * (n - i) + INSERT * len(AT_END[state]), -n, "")
        to = 4 * n
        for nxt, inserted in BETWEEN[state].items():
            if nxt in cheapest:
                cost, at, rerole = cheapest[nxt]
                way = (cost - DELETE * i + INSERT * len(inserted), -at, "I" if inserted else "R" if rerole else "K")
                if way < best:
                    best, to = way, 4 * at + nxt
        return best[0], to

    for i in range(n - 1, -1, -1):
        for state in (SYSTEM, USER, ASSISTANT):
            go_on[state][i], then[state][i] = after(i + 1, state)
        if faults[i] in (BLANK, DUPLICATE):
            continue
        for state in (SYSTEM, USER, ASSISTANT):
            rerole = initials[i] != state
            if state == SYSTEM and rerole:
                continue
            cost = DELETE * i + REROLE * rerole + TRUNCATED * (faults[i] == CUT) + go_on[state][i]
            if state not in cheapest or cost < cheapest[state][0]:  # of equal ones the later turn stays
                cheapest[state] = (cost, i, rerole)
    total, to = after(0, START)
    stay = []
    while to < 4 * n:
        i, state = divmod(to, 4)
        stay.append((i, state))
        to = then[state][i]
    return total, stay


class _Conversation:
    """One conversation as its sorted rows come in: first all without texts, then all with them."""

    def __init__(self, conv_id):
        self.conv_id, self.initials, self.faults, self.seen = conv_id, bytearray(), bytearray(), set()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.stay, self.at, self.state, self.step = None, 0, START, 0

    def learn(self, turn, role, digest, blank, cut) -> None:
        initial = "sua".find(role[:1]) + 1 if role[:1] else START
        if self.initials:
            self.illegal += (self.initials[-1], initial) not in LEGAL
        self.initials.append(initial)
        self.faults.append(BLANK if blank else DUPLICATE if digest in self.seen else CUT if cut else NO_FAULT)
        self.seen.add(digest)
        if turn is not None:
            self.turns += self.low is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def summary(self) -> tuple:
        self.seen = None
        cost, stay = plan(bytes(self.initials), bytes(self.faults))
        self.stay = iter([*stay, (len(self.initials), None)])
        self.next = next(self.stay)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        count = lambda f: self.faults.count(f)
        return (self.conv_id, 0, None, None, None, gaps, count(BLANK), count(DUPLICATE), count(CUT), self.illegal, cost)

    def row(self, edit, role, text) -> tuple:
        self.step += 1
        return (self.conv_id, self.step, edit, role, text, None, None, None, None, None, None)

    def edit(self, role, text) -> Iterator[tuple]:
        """The edits of the next turn: what is inserted before it, then its own."""
        if self.stay is None:
            yield self.summary()
        i, state = self.next
        if self.at < i:
            yield self.row("D", role, text)
        else:
            for inserted in BETWEEN[self.state][state]:
                yield self.row("I", ROLES[inserted], "")
            keeps = self.initials[i] == state
            yield self.row("K" if keeps else "R", role if keeps else ROLES[state], text)
            self.state, self.next = state, next(self.stay)
        self.at += 1

    def end(self) -> Iterator[tuple]:
        if self.stay is None:
            yield self.summary()
        for inserted in AT_END[self.state]:
            yield self.row("I", ROLES[inserted], "")


def _parse(columns: str) -> list[StructField]:
    kinds = {"long": LongType(), "string": StringType()}
    return [StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))]


def _batches(rows: Iterator[tuple], names: list[str], schema, rows_a_batch: int = 2000, chars: int = 4_000_000):
    import pyarrow as pa

    def flush():
        columns = zip(*held) if held else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema)], names=names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= rows_a_batch or size >= chars:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def repair(damaged: DataFrame) -> DataFrame:
    """The edits of every conversation of damage()'s rows, in order, and before them one row with its figures.

    Columns: conv_id, step (0: the figures), edit (K, R, D or I), role and text (as repaired; of a deleted turn as it
    was), and at step 0 gaps, blank, duplicate, truncated, illegal and cost. The rows of a conversation are next to
    each other and in order within a partition, so that a reader of the partition needs no further sort.

    Rows are taken by turn, nulls first; of one turn by role, then by the SHA-256 of the text. A null conv_id is a
    conversation of its own. One whose rows are all dropped, or deleted, has figures only. Further columns are not
    read, tables without rows give none, and repeated rows are duplicates.

    A conversation is one stream: every row is sorted in twice, without its text, from which the figures and the plan
    come, then with it. So a task holds some 100 bytes of each turn of the conversation at hand (digest, role and
    fault, costs) and no text beyond a batch; what a partition sorts may spill. A conversation is not cut over tasks,
    as the digest of the repaired text, which callers ask for, has to read it from beginning to end.
    """
    both = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    views = F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), 2 * F.col("copies") - 1))
    rows = damaged.select(
        "conv_id", "turn", "role", "text", "gone", F.unhex(F.sha2(both, 256)).alias("digest"), (bare == "").alias("is_blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"), F.explode(views).alias("view"),
    ).withColumn("view", F.col("view") % 2)
    rows = rows.withColumn("text", F.when(F.col("view") == 1, F.col("text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "view", "turn", "role", "digest")
    schema = StructType([StructField("conv_id", damaged.schema["conv_id"].dataType), *_parse(EDITS)])
    return rows.mapInArrow(_repaired([f.name for f in schema], to_arrow_schema(schema)), schema)


def _repaired(names: list[str], schema):
    types = [f.type for f in schema]

    def edits(batches) -> Iterator[tuple]:
        now = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "digest", "is_blank", "is_cut", "view"))
            for conv_id, turn, role, text, gone, digest, blank, cut, view in zip(*columns):
                if now is None or now.conv_id != conv_id:
                    if now:
                        yield from now.end()
                    now = _Conversation(conv_id)
                if view:
                    yield from now.edit(role, text)
                elif not gone:
                    now.learn(turn, role, digest, blank, cut)
        if now:
            yield from now.end()

    return lambda batches: _batches(edits(batches), names, types)


def verdicts(edits: DataFrame) -> DataFrame:
    """One row per conversation from the edits as repair() gives them: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit (the edits' initials) and repaired_sha256 (of the turns that are not deleted, `role:text`, joined by newlines).

    Edits are read where they are, without a shuffle: pass what repair() returned, not rows dealt anew.
    """
    schema = StructType([edits.schema["conv_id"], *_parse(FIGURES)])
    return edits.mapInArrow(_digested([f.name for f in schema], to_arrow_schema(schema)), schema)


def _digested(names: list[str], schema):
    types = [f.type for f in schema]

    def one_row_each(batches) -> Iterator[tuple]:
        figures = None
        for batch in batches:
            for conv_id, step, edit, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    if figures:
                        yield (*figures, "".join(audit), digest.hexdigest())
                    figures, audit, digest, first = (conv_id, *counts), [], hashlib.sha256(), True
                    continue
                audit.append(edit)
                if edit != "D":
                    digest.update((b"" if first else b"\n") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
        if figures:
            yield (*figures, "".join(audit), digest.hexdigest())

    return lambda batches: _batches(one_row_each(batches), names, types)


def repair_verdicts(turns: DataFrame) -> DataFrame:
    return verdicts(repair(damage(turns)))
