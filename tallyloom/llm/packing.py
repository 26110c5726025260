"""Sequence packing as a cutting-stock problem (operator 5).

A document is cut into full sequences and a tail shorter than one. How the tails share
sequences is decided on the histogram of their lengths alone (at most capacity - 1
numbers): column generation solves the linear program over patterns, a knapsack dynamic
program prices new patterns. Rounded-down patterns are dealt to the tails by rank within
their length; what rounding leaves is packed by best-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, narrow
from tallyloom.llm.tokens import default_tokenizer, encoder

#: Rows numbered in one window group; bounds a task of the ranking.
BLOCK = 65_536
#: Rows of the linear program; patterns priced at a time.
ROWS, COLUMNS = 1024, 64
#: Rows of the slot table up to which it is broadcast.
SLOTS = 200_000


def knapsack(duals, capacity: int):
    """best[c]: the greatest value within c, duals[l] being the value of length l; take[c]: the last length of it."""
    import numpy as np

    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back, gain = np.zeros(capacity + 1), np.ascontiguousarray(duals[1 : capacity + 1])  # back is best, reversed
    for c in range(1, capacity + 1):
        value = back[capacity + 1 - c :] + gain[:c]
        l = int(value.argmax())
        best[c], take[c] = value[l], l + 1
        back[capacity - c] = value[l]
    return best, take


def patterns_from(best, take, duals, capacity: int) -> list[dict[int, int]]:
    """For each length the best pattern that holds it, if its value is over one sequence; the most valuable first."""
    import numpy as np

    lengths = np.arange(1, capacity + 1)
    value = duals[lengths] + best[capacity - lengths]
    out = []
    for l in lengths[np.argsort(-value, kind="stable")].tolist():
        if duals[l] <= 0 or value[l - 1] <= 1 + 1e-7 or len(out) >= COLUMNS:
            continue
        pattern, c = Counter([l]), capacity - l
        while c > 0:
            if duals[take[c]] > 0:
                pattern[int(take[c])] += 1
            c -= int(take[c])
        out.append(dict(pattern))
    return out


def best_fit(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: sequences with one pattern are handled together."""
    from bisect import bisect_left, insort

    room: list[int] = []  # the rooms of open sequences, ascending
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(pattern: dict[int, int], n: int, left: int) -> None:
        if left not in open_:
            open_[left] = []
            insort(room, left)
        open_[left].append((pattern, n))

    for l in sorted(demand, reverse=True):
        n = demand[l]
        while n > 0:
            k = bisect_left(room, l)
            if k == len(room):  # none fits: new ones, each with as many as go in
                each = min(n, capacity // l)
                put({l: each}, n // each, capacity - each * l)
                n %= each
                continue
            left = room[k]
            pattern, m = open_[left].pop()
            each = min(left // l, n)
            use = min(m, n // each)
            if m > use:
                open_[left].append((pattern, m - use))
            if not open_[left]:
                del open_[left]
                room.pop(k)
            put(pattern | {l: pattern.get(l, 0) + each}, use, left - each * l)
            n -= use * each
    return [x for some in open_.values() for x in some]


def column_generation(demand: dict[int, int], capacity: int, most: int = 400) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used (fractions): the linear program's least number of sequences, or less than one sequence above it.

    Revised simplex over a pool of patterns that starts with best-fit decreasing's. After some pivots, and whenever no
    pattern of the pool improves, the knapsack prices new ones, several at a time, by the duals drawn halfway to those of
    the best dual bound, which keeps them from swinging, then by the duals themselves. It ends, after a first pricing at least,
    where no pattern is worth more than a sequence, or where the dual bound (no set of patterns needs fewer sequences)
    is less than one sequence away. That leaves the slow end of the simplex to no more than `most` pivots between two pricings.
    Demands are moved by a millionth, so that no pivot is degenerate and the simplex cannot cycle. One row per length: the inverse has
    lengths squared numbers, so above ROWS lengths they are rounded up to classes first.
    """
    import numpy as np

    lengths = sorted(demand)
    if not lengths:
        return []
    m = len(lengths)
    row = np.zeros(capacity + 1, np.int64)
    row[lengths] = np.arange(m)
    d = np.array([demand[l] for l in lengths], float)
    moved = d * (1 + 1e-6 * np.random.default_rng(5).random(m))
    inverse = np.diag([1.0 / (capacity // l) for l in lengths])
    x, y = inverse @ moved, inverse.sum(axis=0)  # every pattern costs one sequence
    pool = [{l: capacity // l} for l in lengths] + [p for p, _ in best_fit(demand, capacity)]
    basis, known = np.arange(m), {tuple(sorted(p.items())) for p in pool}
    at, times, first = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def grow(new: list[dict[int, int]]) -> None:
        nonlocal at, times, first
        first = np.concatenate([first, len(at) + np.cumsum([0] + [len(p) for p in new[:-1]])]).astype(np.int64)
        at = np.concatenate([at, row[[l for p in new for l in p]]])
        times = np.concatenate([times, [float(n) for p in new for n in p.values()]])

    def price(values) -> tuple[list[dict[int, int]], float]:
        """New patterns that are worth more than a sequence by the values, and the dual bound of the values."""
        duals = np.zeros(capacity + 1)
        duals[lengths] = np.maximum(values, 0)
        best, take = knapsack(duals, capacity)
        new = patterns_from(best, take, duals, capacity) if best[capacity] > 1 + 1e-7 else []
        return [p for p in new if tuple(sorted(p.items())) not in known], float(duals[lengths] @ d) / max(best[capacity], 1.0)

    grow(pool)
    center = np.array(lengths, float) / capacity  # by it every full pattern is worth a sequence: the bound of the volume
    bound, pivots, priced = float(center @ d), 0, False
    while True:
        value = np.add.reduceat(y[at] * times, first)
        enter = int(value.argmax())
        if value[enter] > 1 + 1e-7 and pivots < most:
            pivots += 1
            here = slice(first[enter], first[enter + 1] if enter + 1 < len(first) else None)
            step = inverse[:, at[here]] @ times[here]
            ratio = np.full(m, np.inf)
            np.divide(x, step, out=ratio, where=step > 1e-9)
            out = int(ratio.argmin())
            theta, pivot = ratio[out], inverse[out] / step[out]
            x = np.maximum(x - theta * step, 0)
            x[out] = theta
            y = y - (value[enter] - 1) * pivot
            some = np.flatnonzero(np.abs(step) > 1e-12)
            some = some[some != out]
            inverse[some] -= step[some, None] * pivot
            inverse[out] = pivot
            basis[out] = enter
            continue
        if priced and x.sum() < bound + 1:
            break
        new, pivots, priced = [], 0, True
        for values in ((y + center) / 2, y):
            more, under = price(values)
            if under > bound:
                bound, center = under, values
            new += [p for p in more if p not in new]
            if new:
                break
        if not new and value[enter] <= 1 + 1e-7:
            break
        known.update(tuple(sorted(p.items())) for p in new)
        if new:
            pool += new
            grow(new)
    return [(pool[b], float(v)) for b, v in zip(basis, x) if v > 1e-6]


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def _loss(plan: list[tuple[dict[int, int], int]], capacity: int) -> int:
    return sum(n * padding(sum(l * a for l, a in p.items()), capacity) for p, n in plan)


#: Fractions from which a pattern is used once more after rounding down; each is tried, 1 being none.
ROUND_UP = (1.0, 0.8, 0.6, 0.4)


def _rounded(patterns: list[tuple[dict[int, int], float]], demand: dict[int, int], real: dict[int, list[int]], capacity: int, up: float) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns, rounded down and then, the largest fractions first, once more from the fraction `up` on
    where the tails for it are left; what is over goes to best-fit decreasing. real: the lengths of each class."""
    left, plan = Counter(demand), []

    def use(pattern: dict[int, int], times: int) -> None:
        n = min([times, *(sum(left[r] for r in real[l]) // a for l, a in pattern.items())])
        while n > 0:  # the longest of each class first; as many sequences at a time as have the same lengths
            chosen: Counter = Counter()
            for l, a in pattern.items():
                for r in reversed(real[l]):
                    got = min(a, left[r])
                    chosen[r] += got
                    a -= got
            chosen = +chosen
            k = min([n, *(left[r] // a for r, a in chosen.items())])
            plan.append((dict(chosen), k))
            for r, a in chosen.items():
                left[r] -= a * k
            n -= k

    for pattern, times in patterns:
        use(pattern, int(times + 1e-3))
    for pattern, times in sorted(patterns, key=lambda p: -(p[1] % 1)):
        if up <= times % 1 < 1 - 1e-3:
            use(pattern, 1)
    return plan + best_fit(+left, capacity)


def plan_tails(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that hold exactly the demand.

    The linear program's patterns are rounded, the rest is packed by best-fit decreasing; of the ways to round, and best-fit
    decreasing alone, the one that pads least is used.
    """
    unit = -(-len(demand) // ROWS)  # above ROWS lengths: classes of unit lengths, each as its longest
    classes, real = Counter(), {}
    for l in sorted(demand):
        up = min(-(-l // unit) * unit, capacity)
        classes[up] += demand[l]
        real.setdefault(up, []).append(l)
    patterns = column_generation(classes, capacity)
    plans = [_rounded(patterns, demand, real, capacity, up) for up in ROUND_UP] + [best_fit(demand, capacity)]
    return min(plans, key=lambda p: _loss(p, capacity))


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, rank after the last, first sequence, offset) rows, and the number of sequences."""
    used, rows, sequence = Counter(), [], 0
    for pattern, n in plan:
        offset = 0
        for l in sorted(pattern, reverse=True):
            for _ in range(pattern[l]):
                rows.append((l, used[l], used[l] + n, sequence, offset))
                used[l] += n
                offset += l
        sequence += n
    return rows, sequence


def by_rank(rows: list[tuple[int, int, int, int, int]], demand: dict[int, int]) -> list[tuple[int, ...]]:
    """The slots with (step, near): each is listed under every multiple `near` of its length's step that it touches.

    A length's step is its number of tails by its number of slots, so that the rows at most double and a
    rank meets few slots."""
    many = Counter(r[0] for r in rows)
    step = {l: -(-demand[l] // n) for l, n in many.items()}
    return [(l, step[l], k, r0, r1, s0, at) for l, r0, r1, s0, at in rows for k in range(r0 // step[l], (r1 - 1) // step[l] + 1)]


def _pieces(path: str, end_id: int, capacity: int):
    """Per document: ids in all and the crc32 of each piece (full ones, then the tail)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, step = encoder(path), 4 * capacity
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, ids, ends in enc.encode_chunks(batch.column("text"), end_id):
                n, sizes, flat = len(ends), np.diff(ends, prepend=0), memoryview(ids).cast("B")
                crcs = [[zlib.crc32(flat[k : min(k + step, to)]) for k in range(to - size, to, step)] for to, size in zip((4 * ends).tolist(), (4 * sizes).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(seq, seq + n)),
                     pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                    names=["doc_id", "part", "seq", "doc_tokens", "crcs"],
                )
                seq += n

    return run


def pack(
    spark: SparkSession, docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give one piece of the id end_id. Rows with null or repeated ids are
    packed like any other row. An empty table gives no pieces. Other columns are not read.
    Very long texts are cut like any other, each full sequence in place; lengths that tie take the
    slots in the order of the input's rows.
    The driver sees the length histogram and the slot table (both bounded by the capacity),
    never documents. Ranks are exact at any size: block counts are summed before each block,
    rows are numbered inside a block of at most BLOCK.
    """
    run = _pieces(tokenizer or default_tokenizer(), end_id, capacity)
    sized = narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, part long, seq long, doc_tokens long, crcs array<long>"
    )
    sized = materialize(spark, sized, "pack-sizes")
    sized = sized.withColumns({
        "block": F.floor(F.col("seq") / BLOCK), "tail": F.col("doc_tokens") % capacity,
        "n_full": F.floor(F.col("doc_tokens") / capacity),
    })
    demand = {r["tail"]: r["count"] for r in sized.where("tail > 0").groupBy("tail").count().collect()}
    rows, used = slots(plan_tails(demand, capacity))
    table = spark.createDataFrame(by_rank(rows, demand), "tail long, step long, near long, r0 long, r1 long, s0 long, offset long")
    steps = table.select("tail", "step").distinct()
    table = F.broadcast(table) if len(rows) <= SLOTS else table

    # Full sequences come after the shared ones, in the order of (part, block, seq).
    in_block = Window.partitionBy("part", "block").orderBy("seq")
    blocks = sized.groupBy("part", "block").agg(F.sum("n_full").alias("size"))
    blocks = blocks.select("part", "block", (F.sum("size").over(Window.orderBy("part", "block")) - F.col("size")).alias("base"))
    full = (
        sized.where("n_full > 0").withColumn("at", F.sum("n_full").over(in_block) - F.col("n_full"))
        .join(blocks, ["part", "block"])
        .select("doc_id", "doc_tokens", (F.col("base") + F.col("at") + used).alias("s0"),
                F.posexplode(F.slice("crcs", F.lit(1), F.col("n_full").cast("int"))).alias("k", "ids_crc32"))
        .select("doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"),
                "ids_crc32", "doc_tokens", (F.col("s0") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    tails = sized.where("tail > 0")
    counts = tails.groupBy("tail", "part", "block").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("tail").orderBy("part", "block")
    counts = counts.select("tail", "part", "block", (F.sum("size").over(order) - F.col("size")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("tail", "part", "block").orderBy("seq")) - 1
    ranked = tails.withColumn("at", inside).join(counts, ["tail", "part", "block"]).withColumn("rank", F.col("base") + F.col("at"))
    # At most capacity - 1 lengths; a rank finds its slot among those that touch its step.
    ranked = ranked.join(F.broadcast(steps), "tail").withColumn("near", F.floor(F.col("rank") / F.col("step")))
    placed = ranked.join(table.drop("step"), ["tail", "near"]).where("rank >= r0 AND rank < r1")
    tail = placed.select(
        "doc_id", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
        (F.col("s0") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset",
    )
    return full.unionAll(tail)
