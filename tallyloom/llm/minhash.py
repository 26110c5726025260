"""Near-duplicates by BagMinHash signatures of word-shingle multisets (operator 8).

Signatures: every shingle carries Poisson processes over discretised weight levels. Level
[0, 1) is one process of rate 1, each octave [2**(j-1), 2**j) one of rate 2**(j-1); a
weight takes the whole octaves below it and, of the octave it ends in, the points whose
level is below the weight. So a heavier copy of a shingle sees all points of a lighter one,
and a register (the earliest point that fell on it) is shared with probability equal to the
weighted Jaccard similarity. Points are generated in time order only until they are later
than the latest register.

Links: registers are banded; documents that share a band meet in a bucket. Buckets are
not expanded into pairs. Rounds compare each member with one pivot of its bucket (first the
one in the middle of the most members), skip what is connected already, and contract connected
documents. What is still apart in a bucket is compared exhaustively, each pair in the first
bucket it shares: small buckets on signatures, large ones block by block on the bags themselves, of
which only a spanning forest of links comes out. Every link is verified on exact multiset overlap
of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import BLOOM, forget, materialize, narrow, session_conf, with_uid
from tallyloom.llm.words import GOLDEN, mix, shingle_hashes, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Members of a bucket beyond which it is compared in blocks; members and shingles of a block.
SMALL, BLOCK, SHINGLES = 64, 512, 4_000_000
BATCH = 256
#: AQE may split a hot bucket's rows in a join even where an aggregation by bucket follows.
SPLIT = {"spark__sql__adaptive__forceOptimizeSkewedJoin": "true"}


def bags(texts: list[str | None], shingle: int = SHINGLE) -> list:
    """Each text's shingle hashes, repeats included. A text of fewer words is one shingle; one without words has none."""
    import numpy as np

    many = [words(t) for t in texts]
    hashes, ends = word_hashes(many)
    whole = shingle_hashes(hashes, shingle)
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= shingle:
            out.append(whole[start : end - shingle + 1])
        else:
            out.append(shingle_hashes(hashes[start:end], n)[:1] if n else np.zeros(0, np.uint64))
        start = end
    return out


def numbered(bag):
    """The multiset as a set: the k-th occurrence of a shingle gets an id of its own."""
    import numpy as np

    h = np.sort(bag)
    first = np.searchsorted(h, h)
    return mix(h + (np.arange(len(h)) - first).astype(np.uint64) * np.uint64(GOLDEN))


def signature(hashes, weights, registers: int):
    """BagMinHash registers (uint64) of distinct hashes with whole-number weights."""
    import numpy as np

    golden = np.uint64(GOLDEN)
    best, who = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    seed, rate, low, weight = [hashes], [np.ones(len(hashes))], [np.zeros(len(hashes))], [weights.astype(float)]
    octave, top = 1, int(weights.max())
    while 2 ** (octave - 1) < top:
        on = weights > 2 ** (octave - 1)
        seed.append(mix(hashes[on] + np.uint64(octave * 0xD1B54A32D192ED03 % 2**64)))
        rate.append(np.full(int(on.sum()), float(2 ** (octave - 1))))
        low.append(rate[-1])
        weight.append(weights[on].astype(float))
        octave += 1
    seed, rate, low, weight = map(np.concatenate, (seed, rate, low, weight))
    time, done = np.zeros(len(seed)), 0
    # Points a stream needs until every register is likely to be filled; then block after block.
    step = int(min(64, max(2, registers * (math.log(registers) + 1) / rate.sum())))
    while len(seed):
        points = mix(seed[:, None] + np.arange(done + 1, done + step + 1, dtype=np.uint64) * golden)
        gap = -np.log((points >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        more = mix(points + golden)
        level = low[:, None] + rate[:, None] * ((more >> np.uint64(11)).astype(float) * 2.0**-53)
        use = (level < weight[:, None]) & (at < best.max())
        reg = ((more & np.uint64(0x7FF)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)[use]
        t, p = at[use], points[use]
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        reg, t, p = reg[order], t[order], p[order]
        early, name = np.full(registers, np.inf), np.zeros(registers, np.uint64)
        early[reg], name[reg] = t, p
        better = early < best
        best[better], who[better] = early[better], name[better]
        time, done = at[:, -1], done + step
        live = time < best.max()
        seed, rate, low, weight, time = seed[live], rate[live], low[live], weight[live], time[live]
    return who


def _signatures(bands: int, rows: int, shingle: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                some = batch.slice(k, BATCH)
                digests, sizes, keys, short = [], [], [], []
                for bag in bags(some.column("text").to_pylist(), shingle):
                    sizes.append(len(bag))
                    if not len(bag):
                        for col in (digests, keys, short):
                            col.append(None)
                        continue
                    ids = np.sort(numbered(bag))
                    digests.append(_digest(ids))
                    who = signature(*np.unique(bag, return_counts=True), bands * rows)
                    band = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
                    for r in range(rows):
                        band = mix(band + who[r::rows])
                    keys.append(band.astype(np.int64))
                    short.append((who >> np.uint64(48)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [some.column("uid"), some.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    names=["uid", "doc_id", "digest", "size", "keys", "sig"],
                )

    return run


def _digest(ids) -> bytes:
    import hashlib

    return hashlib.blake2b(ids.tobytes(), digest_size=16).digest()


def _numbered_bags(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                some = batch.slice(k, BATCH)
                ids = [np.sort(numbered(b).astype(np.int64)) for b in bags(some.column("text").to_pylist(), shingle)]
                yield pa.RecordBatch.from_arrays([some.column("uid"), pa.array(ids, pa.list_(pa.int64()))], names=["uid", "ids"])

    return run


def _blocks(registers: int, least: float, similarity: float):
    """Links of one bucket, or of two blocks of it, between different components.

    A pair is looked at only in the first bucket that it shares. Where bags are shipped it is verified
    here and the links are reduced to a spanning forest of the components (sure);
    else the pairs that signatures and sizes allow are returned.
    """
    agree = math.floor(registers * least)

    def run(table):
        import numpy as np
        import pyarrow as pa

        n = table.num_rows
        here = table["key"][0].as_py()
        col = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        uid, comp, size, side = (col(c) for c in ("uid", "comp", "size", "side"))
        flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        keys = flat("keys").reshape(n, -1)
        sure = table["ids"].null_count == 0
        if sure:
            ids = flat("ids")
            ends = np.cumsum(size)
            _, code = np.unique(ids, return_inverse=True)
            posting = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
            start = np.concatenate([[0], np.cumsum(np.bincount(code))])
        else:
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(n, registers)
        two = side.min() != side.max()  # one block against another
        names, of, many = np.unique(comp, return_inverse=True, return_counts=True)
        hub = of == many.argmax()  # pairs inside the largest component are settled
        root = list(range(len(names)))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        at, a, b = np.arange(n), [], []
        for i in np.flatnonzero(~hub).tolist():
            ok = (of != of[i]) & (hub | (at > i)) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9)
            if two:
                ok &= side != side[i]
            ok = np.flatnonzero(ok)
            same = keys[ok] == keys[i]
            ok = ok[keys[i][same.argmax(axis=1)] == here]
            if not sure:
                ok = ok[(sig[ok] == sig[i]).sum(axis=1) >= agree]
                a += [uid[i]] * len(ok)
                b += uid[ok].tolist()
                continue
            if not len(ok):
                continue
            mine = code[ends[i] - size[i] : ends[i]]
            length = start[mine + 1] - start[mine]
            place = np.repeat(start[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            both = np.bincount(posting[place], minlength=n)[ok]
            ok = ok[both >= similarity * (size[i] + size[ok] - both) - 1e-9]
            found, first = np.unique(of[ok], return_index=True)
            for c, j in zip(found.tolist(), ok[first].tolist()):
                if find(c) != find(int(of[i])):
                    root[find(c)] = find(int(of[i]))
                    a.append(uid[i])
                    b.append(uid[j])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": np.full(len(a), sure)})

    return run


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(comp, root): the least comp reachable over edges (a, b) between comps; only comps with edges.

    Large-star / small-star contraction: each round is a pair of aggregations, the number of rounds
    grows with the logarithm of the component's size. Partial aggregation keeps hubs small. Done when
    every edge belongs to a star: no node has two roots, and no root has one.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(spark, edges, "cc-edges")
    while True:
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("hub"))
        ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
        if ends.where("leaf + hub > 1").isEmpty():
            roots = edges.select(F.col("u").alias("comp"), F.col("v").alias("root"))
            roots._tallyloom_path = edges._tallyloom_path
            return roots
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = materialize(spark, small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        forget(spark, edges)
        edges = out


def _relabel(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (uid, comp, ...) with comps that edges (uids a, b) connect made one; the old nodes and edges are deleted."""
    of = nodes.select("uid", "comp")
    lifted = (
        edges.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )
    roots = components(spark, lifted)
    merged = nodes.join(roots, "comp", "left")
    out = materialize(spark, merged.withColumn("comp", F.coalesce("root", "comp")).drop("root"), "classes")
    forget(spark, roots, nodes, edges)
    return out


def least_alike(similarity: float, registers: int) -> float:
    """Share of equal registers below which a pair is not verified: 6.5 sigma under the similarity.

    With 96 registers and 0.8 a pair at the threshold fails it with less than 3e-9; with the
    bands' miss of 3.2e-6 that is 3.2e-6 in all.
    """
    return similarity - 6.5 * math.sqrt(similarity * (1 - similarity) / registers)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, rounds: int = 1,
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_shingles.

    Two documents are linked if the multiset Jaccard similarity of their five-word shingles
    is at least 0.8; classes are the connected components, class_id is the class's least
    doc_id (rows without id last). A pair at the threshold shares no band with probability
    (1 - 0.8**4)**24 = 3e-6, and in small buckets a further 3e-9 fail the register gate (least_alike). Very
    long texts are shingled whole; pivots that tie go by uid. Null, empty and wordless texts have no shingles and stay alone; a text of
    fewer than five words is one shingle. Rows with null or repeated ids are judged each.
    An empty table gives an empty result. Other columns are not read.
    """
    named = with_uid(spark, narrow(docs, id_col, text_col))
    signed = named.select("uid", "doc_id", "text").mapInArrow(
        _signatures(bands, rows, shingle), "uid long, doc_id long, digest binary, size long, keys array<long>, sig binary"
    )
    signed = materialize(spark, signed, "signatures")
    # Equal multisets become one representative before any bucket is built.
    chosen = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("uid").alias("uid"))
    reps = signed.select("uid", "size", "keys", "sig").join(chosen.select("uid"), "uid", "left_semi")
    reps = materialize(spark, reps, "representatives")
    member = reps.select("uid", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = materialize(spark, member.join(shared, "key"), "buckets")
    # A document in the middle of its near copies is in their buckets more often than the others: round 0's pivot.
    nodes = member.groupBy("uid").agg(F.sum(F.log2("n")).alias("middle")).withColumn("comp", F.col("uid"))
    nodes = materialize(spark, nodes.join(reps.select("uid", "size"), "uid"), "classes")
    with session_conf(spark, **BLOOM):
        bag = materialize(
            spark, named.join(nodes.where("size > 0").select("uid"), "uid", "left_semi").select("uid", "text")
            .mapInArrow(_numbered_bags(shingle), "uid long, ids array<long>"), "bags",
        )

    def verified(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("ids_a", "ids_b"))
        with session_conf(spark, **BLOOM):
            found = pairs.where("a < b").join(bag.toDF("b", "ids_b"), "b").join(bag.toDF("a", "ids_a"), "a")
            over = found.select("a", "b", both.alias("both"), (F.size("ids_a") + F.size("ids_b")).alias("sum"))
            out = materialize(spark, over.where(F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b"), "links")
        forget(spark, pairs)
        return out

    def open_members() -> DataFrame:
        """Members of buckets that hold several components."""
        labelled = member.select("uid", "key").join(nodes, "uid")
        apart = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
        return labelled.join(apart, "key")

    for r in range(rounds):
        labelled = open_members()
        rank = (-F.col("middle"), F.col("uid")) if r == 0 else (F.xxhash64("uid", F.lit(r)), F.col("uid"))
        pivot = labelled.groupBy("key").agg(
            F.min(F.struct(*(c.alias(f"r{k}") for k, c in enumerate(rank)), F.col("uid").alias("p"), F.col("comp").alias("pc"), F.col("size").alias("ps"))).alias("pivot")
        ).select("key", "pivot.p", "pivot.pc", "pivot.ps")
        pairs = labelled.join(pivot, "key").where("comp <> pc").where(_sizes_allow(F.col("size"), F.col("ps"), similarity))
        with session_conf(spark, **SPLIT):
            pairs = materialize(spark, pairs.select(F.least("uid", "p").alias("a"), F.greatest("uid", "p").alias("b")).distinct(), "pairs")
        nodes = _relabel(spark, nodes, verified(pairs))

    # What is still apart in a bucket is compared pair by pair: a large bucket in blocks, with its
    # members' bags, so that only links come out; a small one on signatures, its pairs are verified after.
    least = least_alike(similarity, bands * rows)
    labelled = open_members().select("uid", "key", "comp", "size")
    with session_conf(spark, **SPLIT):
        labelled = materialize(spark, labelled.join(reps.select("uid", "keys", "sig"), "uid"), "open")
    blocks = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    large = F.col("n") > SMALL
    blocks = blocks.select("key", large.alias("large"), F.when(large, F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / SHINGLES)).cast("int")).otherwise(1).alias("n"))
    placed = labelled.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("uid"), F.col("n")).cast("int"))
    twice = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).cast("int").alias("side"),
        "uid", "comp", "size", "keys", "sig", "large",
    )
    # Only members of large buckets meet their bags.
    some = twice.where("large").join(bag, "uid")
    twice = some.unionByName(twice.where("NOT large").withColumn("ids", F.lit(None).cast("array<long>"))).drop("large")
    rest = twice.groupBy("key", "x", "y").applyInArrow(_blocks(bands * rows, least, similarity), "a long, b long, sure boolean")
    rest = materialize(spark, rest, "pairs")
    links = verified(materialize(spark, rest.where("NOT sure").select("a", "b").distinct(), "pairs"))
    sure = materialize(spark, rest.where("sure").select("a", "b").unionAll(links).distinct(), "links")
    forget(spark, rest, links, labelled)
    nodes = _relabel(spark, nodes, sure)
    forget(spark, member, reps, bag)

    labels = signed.select("uid", "doc_id", "size", "digest").join(chosen.toDF("digest", "rep"), "digest", "left")
    labels = labels.join(nodes.select(F.col("uid").alias("rep"), "comp"), "rep", "left")
    labels = materialize(spark, labels.select("uid", "doc_id", "size", F.coalesce("comp", "rep", "uid").alias("comp")), "labels")
    forget(spark, signed, nodes)
    classes = labels.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return labels.join(classes, "comp").select("doc_id", "class_id", "class_size", F.col("size").alias("n_shingles"), "uid")


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-9)
