"""Similar names: candidate pairs by shared pieces, and groups of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.shared import written


def probes(most: int) -> list[tuple[int, int, int]]:
    """(characters that the other name is shorter, number of the piece, shift of its place) of the pieces to look up.

    A name is cut into most + 1 pieces; of two names within `most` edits one has a piece of the other, unchanged.
    Edits before the i-th piece are i at most, those after it most - i, or another piece has fewer edits around it; so few shifts are left.
    """
    return [
        (shorter, i, shift) for shorter in range(most + 1) for i in range(most + 1) for shift in range(-i, i + 1)
        if shorter - (most - i) <= shift <= shorter + (most - i)
    ]


def similar_names(names: DataFrame, block: str, name: str, most: int) -> DataFrame:
    """(block, name_a, name_b, distance): pairs of different names of a block within `most` edits, each once, name_a before name_b.

    The pieces of each distinct name are joined with the substrings that the longer (or equal) name of a pair may share
    with them; Levenshtein's distance, cut off at `most`, confirms. Null names and blocks have no pairs.
    """
    each = names.select(F.col(block).alias("_block"), F.col(name).alias("_name")).where("_block IS NOT NULL AND _name IS NOT NULL").distinct()
    size, k = F.length("_name"), most + 1

    def pieces(places: list[tuple[int, int, int]]) -> Column:
        """(size, i, piece): substrings of the name where the i-th piece of a name of that size may lie."""
        listed = F.expr("array(" + ", ".join(f"named_struct('shorter', {a}, 'i', {i}, 'shift', {s})" for a, i, s in places) + ")")

        def one(p: Column) -> Column:
            n = size - p["shorter"]
            start, stop = F.floor(n * p["i"] / k).cast("int"), F.floor(n * (p["i"] + 1) / k).cast("int")
            at, length = start + p["shift"], stop - start
            inside = (n >= 0) & (at >= 0) & (at + length <= size)
            return F.when(inside, F.struct(n.alias("size"), p["i"].alias("i"), F.substr("_name", at + 1, length).alias("piece")))

        return F.filter(F.transform(listed, one), lambda p: p.isNotNull())

    indexed = each.select("_block", F.col("_name").alias("_other"), F.inline(pieces([(0, i, 0) for i in range(k)])))
    asked = each.select("_block", "_name", F.inline(F.array_distinct(pieces(probes(most)))))
    met = asked.join(indexed, ["_block", "size", "i", "piece"]).where((F.col("size") < F.length("_name")) | (F.col("_other") < F.col("_name")))
    pairs = met.select("_block", F.least("_name", "_other").alias("name_a"), F.greatest("_name", "_other").alias("name_b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("name_a", "name_b", most)).where("distance >= 0").withColumnRenamed("_block", block)


def candidates(left: DataFrame, right: DataFrame, block: str, name: str, key: str, most: int) -> DataFrame:
    """(block, name_a, key_a, name_b, key_b, distance): pairs of a row of left and a row of right, of one block and with
    names within `most` edits; of two rows only the pair by key.

    Names are compared once, however many rows have them. All pairs of rows are given, so blocks should be small; groups()
    gives classes instead. Rows with a null block, name or key have no pairs.
    """
    given = F.col(block).isNotNull() & F.col(name).isNotNull() & F.col(key).isNotNull()
    side = lambda rows, s: rows.where(given).select(block, F.col(name).alias(f"name_{s}"), F.col(key).alias(f"key_{s}"))
    a, b = side(left, "a"), side(right, "b")
    names = left.select(block, name).unionAll(right.select(block, name))
    pairs = similar_names(names, block, name, most)
    way = lambda x, y: F.struct(F.col(x).alias("name_a"), F.col(y).alias("name_b"))
    ways = pairs.select(block, "distance", F.inline(F.array(way("name_a", "name_b"), way("name_b", "name_a"))))
    unlike = ways.join(a, [block, "name_a"]).join(b, [block, "name_b"])
    alike = a.join(b.withColumn("name_a", F.col("name_b")), [block, "name_a"]).withColumn("distance", F.lit(0))
    return unlike.unionByName(alike).where("key_a < key_b").select(block, "name_a", "key_a", "name_b", "key_b", "distance")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of undirected edges with the least node of its component.

    Stars: every node's greater neighbours are hung on its least neighbour, then its smaller ones, until nothing
    changes, in a number of rounds that grows with the logarithm of the longest path; each round is written.
    """
    ordered = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, mark = written(ordered, "edges"), None
    while True:
        both = now.unionAll(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v"), F.col("v")).distinct())


def groups(rows: DataFrame, block: str, name: str, most: int) -> DataFrame:
    """rows with group_name, the least name that a chain of names within `most` edits each leads to in the row's block, and
    group_size, the rows of that group. A row without a block or name is in no group (null, 0). Rows are never paired."""
    pairs = similar_names(rows, block, name, most)
    node = lambda n: F.struct(F.col(block).alias("block"), F.col(n).alias("name"))
    roots = components(pairs.select(node("name_a").alias("a"), node("name_b").alias("b")), "a", "b").select(
        F.col("node.block").alias(block), F.col("node.name").alias(name), F.col("root.name").alias("_root")
    )
    sizes = rows.groupBy(block, name).agg(F.count(F.lit(1)).alias("_n")).where(F.col(block).isNotNull() & F.col(name).isNotNull())
    named = sizes.join(roots, [block, name], "left").withColumn("group_name", F.coalesce("_root", F.col(name)))
    totals = named.groupBy(F.col(block), "group_name").agg(F.sum("_n").alias("group_size"))
    found = named.select(block, name, "group_name").join(totals, [block, "group_name"])
    return rows.join(found, [block, name], "left").select(*rows.columns, "group_name", F.coalesce("group_size", F.lit(0)).alias("group_size"))
