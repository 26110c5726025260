"""Runs of repeating words by block matching (operator 11).

A run of period q and at least 4q words holds, for the power of two b with b <= q < 2b, a
block of b words at a multiple of b, and the same block q words later. So for each b the
blocks of the text at multiples of b become integer-sequence keys of an Aho-Corasick
automaton, which searches the whole text (a block is the pair of its halves' numbers, so
the automaton stays shallow). An occurrence b to 2b - 1 words after a block is a seed,
extended word by word to both sides. Every word of a run occurs four times in its text,
so texts are first cut at words that occur less often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import narrow

LEAST_WORDS, LEAST_POWER = 6, 4
SPANS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space (0x20, 0x09-0x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def looped(doc_id: int | None, words: list) -> list:
    """The words with the loop that the id's checksum asks for; a null id asks for none."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + k % p] for k in range(n - a))]


def segments(ids, rounds: int = 8) -> list[tuple[int, int]]:
    """Stretches (start, stop) that hold all runs: cut, in a few rounds, at words that a stretch has less than LEAST_POWER times."""
    import numpy as np

    stretches = [(0, len(ids))]
    for _ in range(rounds):
        shorter = []
        for start, stop in stretches:
            part = ids[start:stop]
            if len(part) < LEAST_WORDS:
                continue
            _, at, counts = np.unique(part, return_inverse=True, return_counts=True)
            edges = np.concatenate([[-1], np.flatnonzero(counts[at] < LEAST_POWER), [len(part)]])
            long = np.flatnonzero(np.diff(edges) > LEAST_WORDS)
            shorter += [(start + int(edges[k]) + 1, start + int(edges[k + 1])) for k in long]
        if shorter == stretches:
            break
        stretches = shorter
    return stretches


def _agree(a, b, back: bool = False) -> int:
    """How many words at the front (or back) of a and b, of equal length, are the same."""
    done, step = 0, 16
    while done < len(a):
        end = min(done + step, len(a))
        differs = a[len(a) - end : len(a) - done][::-1] != b[len(b) - end : len(b) - done][::-1] if back else a[done:end] != b[done:end]
        if differs.any():
            return done + int(differs.argmax())
        done, step = end, step * 4
    return done


def _name_blocks(names, size: int):
    """For each place the number of the block of size words there, 0 where no block at a multiple of size is the same.

    names: the same for half the size (words for 1). A block is the key (number of its first half, number of its
    second), so that keys stay short however long blocks are; the places half a block apart follow each other
    in the searched sequence.
    """
    import ahocorasick
    import numpy as np

    half, n = size // 2, len(names)
    known = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    at = np.arange(0, n - size + 1, size)
    for number, key in enumerate(dict.fromkeys(zip(names[at].tolist(), names[at + half].tolist())), 1):
        known.add_word(key, number)
    known.make_automaton()
    width = -(-n // half) + 1  # a 0, which no key has, ends each row
    rows = np.zeros(width * half, np.int64)
    rows[:n] = names
    rows = np.ascontiguousarray(rows.reshape(width, half).T)
    hits = np.array(list(known.iter(tuple(rows.ravel().tolist()))), np.int64).reshape(-1, 2)
    row, column = np.divmod(hits[:, 0] - 1, width)
    out = np.zeros(n, np.int64)
    out[column * half + row] = hits[:, 1]
    return out


def _seeds(names, size: int):
    """(start, distance) of blocks at multiples of size that occur again, size to 2 * size - 1 words later."""
    import numpy as np

    there = np.flatnonzero(names)
    there = there[there >= size]
    at = (there // size - 1) * size  # the one block so far before it
    same = names[at] == names[there]
    return at[same], (there - at)[same]


def find_runs(ids) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of an integer array, by start, then period.

    A run is a stretch of smallest period q and at least max(6, 4q) words that cannot be extended with that period.
    A seed inside a run of a shorter period is no new run (both periods hold on a stretch as long as their sum, so the
    shorter divides the longer), and one inside the last stretch of its own period is that stretch again.
    """
    import numpy as np

    out = []
    for offset, stop in segments(ids):
        part = ids[offset:stop]
        names, n, found, size = part + 1, stop - offset, {}, 1
        while LEAST_POWER * size <= n:
            names = _name_blocks(names, size) if size > 1 else names
            at, q = _seeds(names, size)
            # Stretches of shorter periods by start, and how far those up to each of them go
            known = sorted(found)
            ends = np.maximum.accumulate(np.array([0, *(end for _, end in known)]))
            new = (ends[np.searchsorted([left for left, _ in known], at, "right")] < at + size + q) & (LEAST_POWER * q <= n)
            reach: dict[int, int] = {}  # period -> end of the last stretch with it
            for at, q in zip(at[new].tolist(), q[new].tolist()):
                need = at + size + q
                if reach.get(q, 0) >= need:
                    continue
                left = at - _agree(part[:at], part[q : at + q], back=True)
                reach[q] = end = need + _agree(part[at + size : n - q], part[need:])
                if end - left >= max(LEAST_WORDS, LEAST_POWER * q):
                    found.setdefault((left, end), q)
            size *= 2
        out += [(offset + left, end - left, q) for (left, end), q in found.items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    kept, at = [], 0
    for start, stop in sorted((s + q, s + length) for s, length, q in runs):
        kept += words[at:start] if start > at else []
        at = max(at, stop)
    return kept + words[at:]


def _spans(loops: bool):
    def of_batches(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def batch_of(rows):
            ids, sizes, runs, texts = zip(*rows)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in doc] for doc in runs]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, runs_type), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, number = words_of(text.as_py()), {}
                if loops:
                    words = looped(doc_id, words)
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                runs = find_runs(ids)
                rows.append((doc_id, len(words), runs, b" ".join(without_repeats(words, runs))))
                size += len(rows[-1][3])
                if size >= 8_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return of_batches


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every document: its runs as (start, length, period) in words, by start, then
    period, and the text without the words that a run repeats, joined by single spaces. Needs no shuffle.

    loops=True first loops the tails of a tenth of the texts, as the ids' checksums say (a null id: none). Null and
    empty texts have no words. A text is searched whole in one task, which takes memory in proportion to it and time
    nearly so (block sizes are powers of two up to a quarter of the stretch). Runs may overlap and nest; ties do not
    arise, as start and period tell runs apart. Repeated rows and ids, and null ids, are judged row by row, further
    columns are not read, and a table without rows gives none.
    """
    return narrow(docs, id_col, text_col).mapInArrow(_spans(loops), SPANS)


def run_report(found: DataFrame) -> DataFrame:
    """periodic_runs() as counts, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    over = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(over(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
