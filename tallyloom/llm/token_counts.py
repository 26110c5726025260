"""Edit-aware token counts (operator 6).

A document's pre-tokens lie in leaves of LEAF pre-tokens; a segment tree over the leaves keeps
characters and tokens below each node. An edit finds its leaf by characters, re-encodes from
one leaf before it (the boundary context) until the new pre-tokens fall in step with an old
leaf boundary, and puts the new leaves into the tree, updating the sums on the way up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, narrow, with_uid
from tallyloom.llm.tokens import default_tokenizer, encoder

LEAF = 32
@lru_cache(maxsize=8)
def _compiled(added: str | None):
    import regex

    space = r"[^\S\x1c-\x1f]"
    if added is None:
        return regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{space})[^\p{{L}}\p{{N}}])+|{space}+(?!(?!{space})[\s\S])|{space}+"
        )
    own = rf"(?!{added})"  # no other pre-token reaches into an added token, and text before one ends there
    return regex.compile(
        rf"{added}|(?:{own}')(?:s|t|re|ve|m|ll|d)| ?(?:{own}\p{{L}})+| ?(?:{own}\p{{N}})+| ?(?:{own}(?!{space})[^\p{{L}}\p{{N}}])+"
        rf"|(?:{own}{space})+(?:(?={added})|(?!(?!{space})[\s\S]))|(?:{own}{space})+"
    )


def _pattern(text: str, enc):
    """The tokenizer's pre-token pattern; its white space has no U+001C to U+001F, that of `regex` has.

    The plain one is faster; both agree on texts without added tokens."""
    return _compiled(f"(?:{enc.added.pattern})" if enc.has_added(text) else None)


class SumTree:
    """Sums over a list of leaves, each (characters, tokens); leaves are replaced by ranges.

    A node has the sums below it. Leaves keep their slots; a slot may hold several leaves'
    worth after an edit, and the tree is rebuilt when one slot has grown beyond GROWN leaves.
    """

    GROWN = 16

    def __init__(self, leaves: list[tuple[int, int]]) -> None:
        self.slots = [[leaf] for leaf in leaves] or [[(0, 0)]]
        self._build()

    def _build(self) -> None:
        self.size = 1
        while self.size < len(self.slots):
            self.size *= 2
        self.sums = [(0, 0)] * (2 * self.size)
        for k, s in enumerate(self.slots):
            self.sums[self.size + k] = _add(s)
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = _add(self.sums[2 * k : 2 * k + 2])

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def locate(self, at: int) -> tuple[int, int]:
        """The last slot that starts at or before character `at` and has one, and its start."""
        node, start = 1, 0
        at = min(at, max(self.chars - 1, 0))
        while node < self.size:
            node *= 2
            if at >= start + self.sums[node][0]:
                start += self.sums[node][0]
                node += 1
        return min(node - self.size, len(self.slots) - 1), start

    def start_of(self, slot: int) -> int:
        """Characters before a slot."""
        node, start = slot + self.size, 0
        while node > 1:
            if node & 1:
                start += self.sums[node - 1][0]
            node //= 2
        return start

    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Slots first..last hold these leaves from now on."""
        self.slots[first] = leaves
        for k in range(first + 1, last + 1):
            self.slots[k] = []
        if len(leaves) > self.GROWN * (last - first + 1):
            self.slots = [[leaf] for s in self.slots for leaf in s] or [[(0, 0)]]
            self._build()
            return
        for k in range(first, last + 1):
            node = self.size + k
            self.sums[node] = _add(self.slots[k])
            while node > 1:
                node //= 2
                self.sums[node] = _add(self.sums[2 * node : 2 * node + 2])


def _add(pairs) -> tuple[int, int]:
    return sum(p[0] for p in pairs), sum(p[1] for p in pairs)


def leaves_of(text: str, enc, leaf: int = LEAF) -> list[tuple[int, int]]:
    """(characters, tokens) of each run of `leaf` pre-tokens of a whole text."""
    import numpy as np

    parts = _pattern(text, enc).findall(text)
    if not parts:
        return []
    starts = np.arange(0, len(parts), leaf)
    chars = np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), starts)
    tokens = np.add.reduceat(np.fromiter(map(len, map(enc.plain.__getitem__, parts)), np.int64, len(parts)) // 4, starts)
    return list(zip(chars.tolist(), tokens.tolist()))


class CountedText:
    """A text and its tree; encoded counts the pre-tokens that edits had encoded again."""

    def __init__(self, text: str, leaves: list[tuple[int, int]], enc, leaf: int = LEAF) -> None:
        self.text, self.tree, self.enc, self.leaf, self.encoded = text, SumTree(leaves), enc, leaf, 0

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace `delete` characters from `at` by insert; both are cut to the text."""
        old, tree = self.text, self.tree
        at = min(max(at, 0), len(old))
        delete = min(max(delete, 0), len(old) - at)
        self.text, moved = old[:at] + insert + old[at + delete :], len(insert) - delete
        # Where a pre-token ends depends on two characters behind its end at most, or on an added token there.
        context = max(at - max(3, self.enc.longest_added + 1), 0)
        first, start = tree.locate(context)
        while start > context:
            first -= 1
            start = tree.start_of(first)
        last, low = tree.locate(at + delete)
        last = max(first, last)
        place = tree.start_of(last) + tree.sums[tree.size + last][0]  # the old end of slot `last`
        fresh, chars, tokens, n, end = [], 0, 0, 0, start
        for m in _pattern(self.text, self.enc).finditer(self.text, start):
            end, n = m.end(), n + 1
            chars += end - m.start()
            tokens += len(self.enc.plain[m[0]]) // 4
            self.encoded += 1
            # Old leaf boundaries behind the edit, in the new text's characters.
            while last < len(tree.slots) - 1 and (place < at + delete or place + moved < end):
                last += 1
                place += tree.sums[tree.size + last][0]
            step = place >= at + delete and place + moved == end and end >= at + len(insert)
            if n == self.leaf or step:
                fresh.append((chars, tokens))
                chars = tokens = n = 0
            if step:
                break
        else:
            last = len(tree.slots) - 1
        if n:
            fresh.append((chars, tokens))
        tree.replace(first, last, fresh)

    def leaves(self) -> list[tuple[int, int]]:
        return [leaf for s in self.tree.slots for leaf in s]


def _build(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                trees = [leaves_of(t or "", enc) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("uid"), *(pa.array([[x[i] for x in t] for t in trees], pa.list_(pa.int32())) for i in (0, 1))],
                    names=["uid", "leaf_chars", "leaf_tokens"],
                )

    return run


def _apply(path: str, with_text: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some, rows = batch.slice(k, 256), []
                for text, chars, tokens, edits in zip(*(some.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits"))):
                    doc = CountedText(text or "", list(zip(chars or [], tokens or [])), enc)
                    before = doc.tree.tokens
                    for e in edits or []:
                        doc.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                    leaves = doc.leaves()
                    rows.append((before, len(edits or []), doc.tree.tokens, doc.encoded, doc.text if with_text else None, [x[0] for x in leaves], [x[1] for x in leaves]))
                cols, ints = list(zip(*rows)) or [[]] * 7, pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column("uid"), some.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(), ints, ints)))],
                    names=["uid", "doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded", "text", "leaf_chars", "leaf_tokens"],
                )

    return run


def build_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(uid, leaf_chars, leaf_tokens) of documents (uid, text): the trees' leaves, in text order.

    Null texts count as empty and have no leaves."""
    return docs.select("uid", "text").mapInArrow(_build(tokenizer or default_tokenizer()), "uid long, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """Documents (uid, doc_id, text) after their edits, with counts before and after and new leaves.

    edits: (uid, seq, at, delete, insert); those of one document are applied by seq (ties by the
    other columns), each to the text the ones before it left. Positions are characters and are cut
    to the text; null positions count as 0, a null insert as empty. Edits without a document
    do nothing; documents without edits keep their counts. A document must fit one task, with its edits.
    """
    listed = edits.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "delete", "insert"))).alias("edits"))
    joined = docs.select("uid", "doc_id", "text").join(trees, "uid", "left").join(listed, "uid", "left")
    kind = "uid long, doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long, text string, leaf_chars array<int>, leaf_tokens array<int>"
    return joined.mapInArrow(_apply(tokenizer or default_tokenizer(), with_text), kind)


def standard_edits(docs: DataFrame) -> DataFrame:
    """Three edits a document, from its length alone: an insertion, a deletion, a replacement."""
    n = F.coalesce(F.length("text"), F.lit(0))
    rows = [(F.floor(n / 3), 0, "edited text, "), (F.floor(n / 2), 7, ""), (F.floor(n * 3 / 4), 5, "Stra\u00dfe 42")]
    edits = [
        F.struct(F.lit(k).alias("seq"), at.cast("long").alias("at"), F.lit(d).cast("long").alias("delete"), F.lit(i).alias("insert"))
        for k, (at, d, i) in enumerate(rows)
    ]
    return docs.select("uid", F.inline(F.array(*edits)))


def edited_counts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The standard edits on every document: doc_id, n_tokens, n_edits, n_tokens_after, n_reencoded.

    Rows with null or repeated ids are documents of their own; empty tables give no rows. A null or empty text has no
    tokens and takes the inserts; a very long text is counted and edited whole in one task. Repeated texts are
    counted each, edits do not tie, and further columns, whatever their names, are not read.
    """
    named = with_uid(spark, narrow(docs, id_col, text_col))
    trees = materialize(spark, build_trees(named), "trees")
    edited = apply_edits(named, trees, standard_edits(named), with_text=False)
    return edited.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded")
