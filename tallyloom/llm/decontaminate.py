"""Benchmark decontamination by a prefix-filtered containment join (operator 7).

Items are cut into windows of their words, windows into shingles. Shingles are ordered by
rarity in the whole corpus; for full containment one prefix token is necessary, the rarest
shingle of the window. Documents meet windows in an equi-join on that token, positional
and length bounds drop what cannot fit, and the words themselves are compared at last.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, materialize
from tallyloom.llm.words import shingle_hashes, word_hashes, words

WINDOW, SHINGLE = 10, 5
#: Largest bitmap sent to the tasks, in bits (16 MB); a larger benchmark only passes more candidates on.
MOST_BITS = 27
BATCH = 512


def _item_windows(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts, sizes = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                for k in range(max(1, len(w) - window + 1) if w else 0):
                    ids.append(item)
                    texts.append(b" ".join(w[k : k + window]).decode("utf-8", "surrogatepass"))
                    sizes.append(min(window, len(w)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=["item_id", "words", "size"])

    return run


def _window_shingles(shingle: int):
    """Each window's shingles: their hash, size and place in the window."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = ([], [], [], [])
            for text in batch.column("words").to_pylist():
                w = text.encode("utf-8", "surrogatepass").split()
                size = min(shingle, len(w))
                h = shingle_hashes(word_hashes([w])[0], size)[: len(w) - size + 1].astype(np.int64)
                for at, x in enumerate(h.tolist()):
                    for col, v in zip(rows, (text, x, size, at)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int32(), pa.int32()))],
                names=["words", "token", "token_size", "at"],
            )

    return run


def bitmap(tokens: DataFrame) -> tuple[dict[int, bytes], int]:
    """Bitmaps of token hashes by token size, and their number of bits as a power of two.

    Bits are set by Spark and come to the driver as words of at most 2**MOST_BITS bits.
    """
    import numpy as np

    n = tokens.count()
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
    place = F.shiftrightunsigned("token", 64 - bits)
    cells = (
        tokens.groupBy("token_size", F.shiftright(place, 5).alias("cell"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - bits}) & 31 as int))")).alias("on"))
        .toPandas()
    )
    out = {}
    for size, part in cells.groupby("token_size"):
        words32 = np.zeros(1 << (bits - 5), "<u4")
        words32[part["cell"].to_numpy()] = part["on"].to_numpy().astype(np.uint32)
        out[int(size)] = words32.tobytes()
    return out, bits


def _hits(many, maps: dict[int, bytes], bits: int):
    """Places in many documents' words whose shingle may be a token: (place, size, hash) arrays by size."""
    import numpy as np

    hashes, ends = word_hashes(many)
    last = np.repeat(ends, [len(w) for w in many])  # the end of each place's document
    for size, cells in maps.items():
        cells = np.frombuffer(cells, "<u4")
        h = shingle_hashes(hashes, size)
        place = h >> np.uint64(64 - bits)
        on = (cells[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & 1
        at = np.flatnonzero(on)
        at = at[at + size <= last[at]]
        yield at, size, h[at].astype(np.int64)
    yield ends, 0, None


def _count_tokens(maps: dict[int, bytes], bits: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                many = [words(t) for t in batch.column("text").slice(k, BATCH).to_pylist()]
                for _, size, h in _hits(many, maps, bits):
                    if size and len(h):
                        token, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(token), pa.array(np.full(len(n), size, np.int32)), pa.array(n.astype(np.int64))],
                            names=["token", "token_size", "n"],
                        )

    return run


def _candidates(maps: dict[int, bytes], bits: int, window: int, shingle: int):
    """Each document's places that may be a window's prefix token, with the words around that a window could take.

    A token of fewer words than a shingle is a whole window: it brings its own words only."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("token", pa.int64()), ("token_size", pa.int32()), ("pos", pa.int64()), ("lead", pa.int32()), ("near", pa.string())]))
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                some = batch.slice(k, BATCH)
                many = [words(t) for t in some.column("text").to_pylist()]
                found: list[list[dict]] = [[] for _ in many]
                starts = np.cumsum([0] + [len(w) for w in many])
                for at, size, h in _hits(many, maps, bits):
                    if not size:
                        continue
                    reach = size if size < shingle else window
                    for d, p, x in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist(), h.tolist()):
                        p -= int(starts[d])
                        low = max(0, p + size - reach)
                        near = b" ".join(many[d][low : p + reach]).decode("utf-8", "surrogatepass")
                        found[d].append({"token": x, "token_size": size, "pos": p, "lead": p - low, "near": near})
                n = len(many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), some.column("doc_id"), pa.array([len(w) for w in many], pa.int64()), pa.array(found, kind)],
                    names=["uid", "doc_id", "n_words", "found"],
                )
                uid += n

    return run


def contamination(
    spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of a window of window item words (an item of
    fewer words, but not none, is one window). Null and empty texts have no words; items
    without words never occur; an item with a null id hits words but is in no list of items.
    Very long texts are read whole; windows that tie in rarity go by hash and place. Repeated rows are
    judged each; an empty table of either kind works. Other columns are not read.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    items = items.select(items[item_col].cast("string").alias("item_id"), items[item_text_col].cast("string").alias("text"))
    owned = materialize(spark, items.mapInArrow(_item_windows(window), "item_id string, words string, size int").distinct(), "windows")
    tokens = owned.select("words").distinct().mapInArrow(
        _window_shingles(shingle), "words string, token long, token_size int, at int"
    )
    tokens = materialize(spark, tokens, "window-tokens")

    # Rarity over the whole corpus, then the rarest shingle of each window.
    maps, bits = bitmap(tokens.select("token", "token_size").distinct())
    counts = docs.select("text").mapInArrow(_count_tokens(maps, bits), "token long, token_size int, n long")
    counts = counts.groupBy("token", "token_size").agg(F.sum("n").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), "token", "at")
    prefix = (
        tokens.join(counts, ["token", "token_size"], "left")
        .groupBy("words").agg(F.min_by(F.struct("token", "token_size", "at"), order).alias("p"))
        .select("words", "p.*")
    )
    prefix = materialize(spark, prefix.withColumn("size", F.size(F.split("words", " "))), "window-prefix")
    forget(spark, tokens)

    maps, bits = bitmap(prefix.select("token", "token_size").distinct())
    seen = docs.mapInArrow(
        _candidates(maps, bits, window, shingle),
        "uid long, doc_id long, n_words long, found array<struct<token:long,token_size:int,pos:long,lead:int,near:string>>",
    )
    seen = materialize(spark, seen, "contamination")
    near = seen.where("size(found) > 0").select("uid", "n_words", F.inline("found"))
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("at"))  # positional and length bounds
    same = F.array_join(F.slice(F.split("near", " "), F.col("lead") - F.col("at") + 1, F.col("size")), " ") == F.col("words")
    # Without the bound on lead, slice() would be asked for places before the array.
    occurs = near.join(prefix, ["token", "token_size"]).where(F.when(fits, same)).select(
        "uid", start.alias("start"), (start + F.col("size")).alias("stop"), "words"
    ).distinct()
    occurs = materialize(spark, occurs, "occurrences")
    before = Window.partitionBy("uid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    hit = (
        occurs.select("uid", F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0)).alias("n"))
        .groupBy("uid").agg(F.sum("n").alias("n_hit"))
    )
    listed = (
        occurs.select("uid", "words").distinct().join(owned.where("item_id IS NOT NULL"), "words")
        .groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    named = F.coalesce("items", F.array().cast("array<string>"))
    return seen.select("uid", "doc_id", "n_words").join(hit, "uid", "left").join(listed, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[k : k + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, k, array_to_string(words[k : k + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM w, sizes WHERE len(words) >= size)),
occ AS (SELECT p.doc_id, p.k, p.size, o.item_id FROM places p JOIN windows o ON p.win = o.win AND p.size = o.size),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM occ) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
  sha256(coalesce(listed.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
