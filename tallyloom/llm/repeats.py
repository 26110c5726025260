"""Removal of repeated byte strings with a difference cover (operator 3).

A string of LENGTH bytes that also starts elsewhere is repeated; every byte that such a
string covers goes. Prefixes of LENGTH bytes decide, so suffixes are named, not ranked.

1. Sample. The positions whose remainder modulo PERIOD lies in a difference cover, 9 % of all: for any two
   positions there is one distance below PERIOD at which both meet the sample, and there the
   sampled tuples of LENGTH - PERIOD + 1 bytes of equal strings are equal. Tuples are sorted out
   by their names; what occurs once is done with.
2. Names of names. A sampled position with the PERIOD strings that start before it and hold its tuple is a block.
   Blocks of one tuple with equal bytes get one name; all strings of a block whose name occurs twice are
   repeated. Hot passages collapse to one row here.
3. The remaining suffixes. Blocks of different names are named again by the bytes on either side of the
   tuple; only strings on a side that several names share are left. They are counted by the name of their LENGTH
   bytes (one block stands for all of its name), and names that occur twice are joined back to their places.
   Nothing is sorted: equality of names stands for equality of bytes.

Names are two polynomial hashes with byte tables of their own. Blocks and remaining suffixes are handled in
PASSES ranges of their names, one after another, which bounds the disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import BLOOM, forget, materialize, narrow, session_conf, with_uid
from tallyloom.llm.words import mix

LENGTH = 200
#: Period of the cover, q * q + q + 1 for a prime q: a perfect difference set of q + 1 remainders exists.
PRIME = 11
PERIOD = PRIME * PRIME + PRIME + 1
PASSES = 3
#: String starts handled at a time, so that a very long text needs little memory.
SEGMENT = 1 << 18
#: Documents of an Arrow batch that are read together.
DOCS = 64


@lru_cache(maxsize=1)
def cover() -> tuple[int, ...]:
    """A perfect difference set modulo PERIOD: every other remainder is one difference of its members.

    Multiplication by PRIME maps such a set onto a shift of itself; the set is put together from orbits of it.
    """
    orbits = {frozenset(x * PRIME**k % PERIOD for k in range(3)) for x in range(PERIOD)}
    orbits = sorted(sorted(o) for o in orbits)

    def extend(have: list[int], seen: set[int], at: int) -> list[int] | None:
        if len(have) == PRIME + 1:
            return have
        for k in range(at, len(orbits)):
            more = have + orbits[k]
            new = [(x - y) % PERIOD for x in more for y in more if x != y and not (x in have and y in have)]
            if len(more) <= PRIME + 1 and len(set(new)) == len(new) and not seen & set(new):
                found = extend(more, seen | set(new), k + 1)
                if found:
                    return found
        return None

    return tuple(sorted(extend([], set(), 0)))


@lru_cache(maxsize=1)
def _powers():
    """Two polynomial hashes modulo 2**64: byte values, powers and inverse powers of an odd base."""
    import numpy as np

    rng, out = np.random.default_rng(3), []
    for base in (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F):
        values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = SEGMENT + 4 * LENGTH
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])
        out.append((values, power, inverse))
    return out


def _prefix(data, which: int):
    import numpy as np

    values, power, _ = _powers()[which]
    return np.r_[np.uint64(0), np.cumsum(values[data] * power[: len(data)])]


def _hash(prefix, starts, ends, which: int):
    return (prefix[ends] - prefix[starts]) * _powers()[which][2][starts]


def blocks_of(texts: list[bytes], length: int = LENGTH, only: tuple[int, int] | None = None, names: bool = True):
    """Arrays of the blocks of many texts: the text's number, the sampled place, first start, last start, tuple hash and, if asked for,
    two hashes of the block's bytes, hashes of the bytes around the tuple that every string starting half() or more before it has (left)
    and that every other has (right), 0 where the block has no such string. only: (k, n), tuples whose hash is k modulo n.

    Texts are joined up to SEGMENT bytes, longer ones are read in segments."""
    import numpy as np

    out, gram = [], length - PERIOD + 1
    for held in _joined(texts, length):
        data, owner, start, size, low, high = held  # a text's place in data, its bytes there, and the range of sampled places wanted
        near = _sampled(int(high.max()))
        begin, end = np.searchsorted(near, low), np.searchsorted(near, high)
        many = end - begin
        of = np.repeat(np.arange(len(owner)), many)
        local = near[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[of]]
        shift = (start - np.maximum(0, low - PERIOD + 1))[of]  # from a place in the text to one in data
        one = _prefix(data, 0)
        tuples = mix(_hash(one, local + shift, local + shift + gram, 0))
        if only:
            keep = (tuples >> np.uint64(8)) % np.uint64(only[1]) == only[0]
            local, shift, of, tuples = local[keep], shift[keep], of[keep], tuples[keep]
        if not names:
            out.append((tuples,))
            continue
        first, last = np.maximum(0, local - PERIOD + 1), np.minimum(local, size[of] - length)
        two, far, more = _prefix(data, 1), half(length), []
        for i, h in enumerate((one, two)):
            more.append(mix(_hash(h, first + shift, last + shift + length, i)))
        for some, a, b in ((local - first >= far, local - far, local + gram), (local - last <= far, local, local + length - far)):
            hashes = np.zeros(len(local), np.uint64)
            hashes[some] = mix(_hash(one, (a + shift)[some], (b + shift)[some], 0)) | np.uint64(1)
            more.append(hashes)
        out.append((owner[of], local, first, last, tuples, *more))
    if not out:
        return [np.zeros(0, np.int64)] * 4 * names + [np.zeros(0, np.uint64)] * (5 if names else 1)
    return [np.concatenate(c) for c in zip(*out)]


def _joined(texts: list[bytes], length: int):
    """Texts joined to arrays of about SEGMENT bytes, with what blocks_of needs of each; a longer text in segments of its sampled places."""
    import numpy as np

    gram, held, room = length - PERIOD + 1, [], 0

    def out():
        data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        sizes = np.array([len(x[0]) for x in held], np.int64)
        owner, size, low, high = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3, 4))
        return data, owner, np.cumsum(sizes) - sizes, size, low, high

    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for s in range(0, len(text) - gram + 1, SEGMENT):
            high = min(s + SEGMENT, len(text) - gram + 1)
            part = text if len(text) <= SEGMENT else text[max(0, s - PERIOD + 1) : high - 1 + length]
            if held and room + len(part) > SEGMENT:
                yield out()
                held, room = [], 0
            held.append((part, k, len(text), s, high))
            room += len(part)
    if held:
        yield out()


_places = [0, None]


def _sampled(n: int):
    """The sampled places below n or more, ascending; kept per worker."""
    import numpy as np

    if _places[1] is None or _places[0] < n:
        turns = np.arange(-(-n // PERIOD) + 1) * PERIOD
        _places[:] = [n, (turns[:, None] + np.array(cover())).ravel()]
    return _places[1]


def half(length: int) -> int:
    return (PERIOD - 1) // 2


def _bytes(text: str | None):
    import numpy as np

    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _tuples(length: int):
    """The names of all sampled tuples."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, DOCS):
                (names,) = blocks_of(_encoded(batch.column("text").slice(k, DOCS)), length, names=False)
                yield pa.RecordBatch.from_arrays([pa.array(names.view("i8"))], names=["gram"])

    return run


_BLOCK = "uid long, place int, shape int, gram long, one long, two long, sides long"  # shape: lead * 256 + size; sides: left and right


def _blocks(length: int, only: tuple[int, int]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, DOCS):
                uid = batch.column("uid").slice(k, DOCS).to_numpy()
                of, p, first, last, gram, one, two, left, right = blocks_of(_encoded(batch.column("text").slice(k, DOCS)), length, only)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[of]), pa.array(p.astype(np.int32)), pa.array(((p - first << 8) + last - first).astype(np.int32)),
                     *(pa.array(x.view("i8")) for x in (gram, one, two, (left << np.uint64(32)) | (right & np.uint64(0xFFFFFFFF))))],
                    names=["uid", "place", "shape", "gram", "one", "two", "sides"],
                )

    return run


def _encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _lists(column):
    """The values of a column of lists (null: empty) as one array, and each row's first and end in it."""
    import numpy as np

    ends = np.cumsum(np.array(column.value_lengths().fill_null(0), np.int64))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _rebatched(run, rows: int = 50_000):
    """Join a generator's small batches, so that Spark gets few and large ones."""

    def out(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _strings(length: int, only: tuple[int, int]):
    """Names of the wanted strings: (key1, key2, uid, start), start null if it needs no mark; each start once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            packed, begin, end = _lists(batch.column("wanted"))
            for uid, text, lo, hi in zip(batch.column("uid").to_pylist(), batch.column("text"), begin.tolist(), end.tolist()):
                data, x = _bytes(text.as_py()), packed[lo:hi]
                first, size, single = x >> 9, x >> 1 & 255, x & 1
                want, mark = (_covered(first[use], (first + size + 1)[use], len(data)) for use in (slice(None), single > 0))
                for s in range(0, len(data), SEGMENT):
                    at = np.flatnonzero(want[s : s + SEGMENT])
                    if not len(at):
                        continue
                    part = data[s : s + SEGMENT + length - 1]
                    one = mix(_hash(_prefix(part, 0), at, at + length, 0))
                    keep = (one >> np.uint64(8)) % np.uint64(only[1]) == only[0]
                    at, one = at[keep], one[keep]
                    two = mix(_hash(_prefix(part, 1), at, at + length, 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view("i8")), pa.array(two.view("i8")), pa.array(np.full(len(at), uid)), pa.array((at + s).astype(np.int32), mask=~mark[at + s])],
                        names=["key1", "key2", "uid", "start"],
                    )

    return run


def _covered(first, end, n: int):
    """Which of n places lie in a range."""
    import numpy as np

    if not len(first):
        return np.zeros(n, bool)
    step = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def _cut(length: int):
    """Per document: what remains when the marked strings' bytes are gone."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, (packed, begin, end) = [], _lists(batch.column("ranges"))
            for text, lo, hi in zip(batch.column("text"), begin.tolist(), end.tolist()):
                data, x = _bytes(text.as_py()), packed[lo:hi]
                gone = _covered(x >> 8, (x >> 8) + (x & 255) + length, len(data))
                spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; null counts as empty; texts under `length` bytes keep all; very long texts are
    read in segments. Strings are judged on the input. Rows with null or repeated ids are documents of
    their own, so equal rows remove each other's bytes. An empty table gives no rows. Other columns are
    not read. length is over PERIOD. Blocks and strings are equal if two 64-bit hashes with tables of their own are.
    """
    named = with_uid(spark, narrow(docs, id_col, text_col))
    texts = named.select("uid", "text")
    name = ["gram", "shape", "one", "two"]
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000", **BLOOM):
        tuples = texts.mapInArrow(_rebatched(_tuples(length)), "gram long")
        tuples = materialize(spark, tuples.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "tuples")
        whole, wanted = zip(*(_one_range(spark, texts, tuples, name, length, (k, passes)) for k in range(passes)))
        forget(spark, tuples)
        asked = _union(wanted).groupBy("uid").agg(F.collect_list("wanted").alias("wanted"))
        asked = materialize(spark, texts.join(asked, "uid").select("uid", "text", "wanted"), "wanted")
        forget(spark, *wanted)
        partial = []
        for k in range(passes):
            strings = asked.mapInArrow(_rebatched(_strings(length, (k, passes))), "key1 long, key2 long, uid long, start int")
            strings = materialize(spark, strings, "strings", dictionary=False)
            keys = strings.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key1", "key2")
            found = strings.where("start IS NOT NULL").join(keys.hint("shuffle_hash"), ["key1", "key2"], "left_semi")
            partial.append(materialize(spark, found.select("uid", F.shiftleft(F.col("start").cast("long"), 8).alias("range")), "repeated-starts"))
            forget(spark, strings)
        forget(spark, asked)
        ranges = _union([*whole, *partial]).groupBy("uid").agg(F.collect_list("range").alias("ranges"))
        ranges = materialize(spark, ranges, "repeats")
        forget(spark, *whole, *partial)
        cut = named.join(ranges, "uid", "left").select("doc_id", "text", "ranges")
        kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        out = materialize(spark, cut.mapInArrow(_cut(length), kind), "cut")
        forget(spark, ranges)
        return out


def _union(frames) -> DataFrame:
    out, *rest = frames
    for f in rest:
        out = out.unionAll(f)
    return out


def _one_range(spark: SparkSession, texts: DataFrame, tuples: DataFrame, name: list[str], length: int, only: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of the blocks whose tuple lies in a range: those that are repeated as a whole (uid, range: first start * 256 + starts after it),
    and the starts that are left (uid, wanted: such a range * 2 + single); single is 0 where the block stands for others that are marked already."""
    every = texts.mapInArrow(_rebatched(_blocks(length, only)), _BLOCK)
    mine = tuples.where(F.pmod(F.shiftrightunsigned("gram", 8), F.lit(only[1])) == only[0])
    some = materialize(spark, every.join(mine.hint("shuffle_hash"), "gram", "left_semi"), "shared-blocks", dictionary=False)
    named = some.groupBy(*name).agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"), F.min_by("place", "uid").alias("place"), F.min("sides").alias("sides")
    )
    named = named.select(*name, "n", "uid", "place", F.shiftrightunsigned("sides", 32).alias("left"), F.col("sides").bitwiseAND(0xFFFFFFFF).alias("right"))
    named = materialize(spark, named, "block-names", dictionary=False)
    twice = named.where("n > 1").select(*name)
    first, size = F.col("place") - F.shiftright("shape", 8), F.col("shape").bitwiseAND(255)
    packed = F.shiftleft(first.cast("long"), 8) + size
    whole = some.join(twice.hint("shuffle_hash"), name, "left_semi").select("uid", packed.alias("range"))
    whole = materialize(spark, whole, "whole-blocks")
    forget(spark, some)

    # A string has the block's left bytes if it starts far or more before the tuple, the right ones if
    # it starts at far or later. Bytes that only one name has are in no repeated string of another.
    far, known = half(length), named
    for side in ("left", "right"):
        various = named.where(f"{side} <> 0").groupBy("gram", side).agg(F.count(F.lit(1)).alias(f"{side}_names")).where(f"{side}_names > 1")
        known = known.join(various.hint("shuffle_hash"), ["gram", side], "left")
    begin = F.when(F.col("left_names").isNull(), F.greatest(first, F.col("place") - far + 1)).otherwise(first)
    end = first + size
    end = F.when(F.col("right_names").isNull(), F.least(end, F.col("place") - far - 1)).otherwise(end)
    known = known.select("uid", begin.cast("long").alias("first"), end.cast("long").alias("last"), (F.col("n") == 1).cast("int").alias("single")).where("first <= last")
    known = known.select("uid", (F.shiftleft("first", 9) + F.shiftleft(F.col("last") - F.col("first"), 1) + F.col("single")).alias("wanted"))
    wanted = materialize(spark, known, "wanted-starts")
    forget(spark, named)
    return whole, wanted
