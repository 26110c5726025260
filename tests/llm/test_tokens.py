import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing, token_counts, token_orc, tokens
from tallyloom.llm.common import fresh_path, session_conf
from tallyloom.llm.tokens import UnitEncoder, default_tokenizer, encoder

PATH = default_tokenizer()
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


pieces = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x1c\x1f'sdlvemrtZa09.,!_éß×²漢\x85\xa0")), st.characters(exclude_categories=["Cs"])), max_size=40)
#: Half of the texts hold the added token's string, or parts of it, next to anything.
odd = st.one_of(pieces, st.lists(st.one_of(pieces, st.sampled_from(["<|endoftext|>", " <|endoftext|> ", "<|endof", "text|>", "<|", "|>"])), max_size=6).map("".join))


@settings(max_examples=400, deadline=None)
@given(odd)
def test_units_give_the_tokenizers_ids(text):
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(odd, st.lists(st.tuples(st.integers(0, 45), st.integers(0, 9), odd), max_size=6), st.sampled_from([1, 2, 4]))
def test_edited_counts_equal_encoding_anew(text, edits, leaf):
    enc = encoder(PATH)
    doc = token_counts.CountedText(text, token_counts.leaves_of(text, enc, leaf), enc, leaf)
    for edit in edits:
        doc.edit(*edit)
        assert doc.tree.tokens == len(ids_of(doc.text)) and doc.tree.chars == len(doc.text)


def test_added_tokens_are_the_librarys():
    text = "x <|endoftext|> y"
    assert ids_of(text) == [87, 220, 50256, 331]
    for t in (text, "<|endoftext|>", "<|endoftext|><|endoftext|>", "  <|endoftext|>", "<|endoftext|>  ", "\n<|endoftext|>\n a", "'<|endoftext|>'s"):
        assert np.frombuffer(encoder(PATH).encode(t), "<u4").tolist() == ids_of(t)
        assert sum(n for _, n in token_counts.leaves_of(t, encoder(PATH))) == len(ids_of(t))


def test_words_go_to_the_model_alone():
    """Line feeds and marks at a unit's end are cut off: only marks and numbers need the whole tokenizer, each once."""

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return PLAIN.encode(text, **options)

    enc, asked = UnitEncoder(PATH), []
    enc.tokenizer = Counted()
    text = "Erst.\nZweit dritt%%% viert.***\nfünft,###\nsechst it's they'll don't!' _a_ b_c_ 7,%\n(8)."
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids_of(text)
    assert not any(x.strip() in asked for x in ("Erst.\nZweit", "dritt%%%", "viert.***\nfünft,###\nsechst", "Erst.", "fünft,###"))
    before = len(asked)
    new = "Neunt.\nZehnt elft%%% zwölft.***\nletzt,###"
    assert np.frombuffer(enc.encode(new), "<u4").tolist() == ids_of(new) and len(asked) == before


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Wort", "fünf", "ñ", "漢", "д", "²", "9", "\n", "\n\n", " ", "\t", "\x1c", "\xa0", "\u0301", "'", "'s", "'ll", "_", ".", ",%", "***", "!'", "…", "–"]), max_size=12).map("".join))
def test_cut_units_give_the_tokenizers_ids(text):
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


def column_ids(enc, texts, kind="string"):
    """The ids of each text, end id 2 last, by encode_chunks."""
    got = []
    for at, ids, ends in enc.encode_chunks(pa.array(["left", *texts], kind).slice(1), 2):
        assert at == len(got)
        got += [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert ends[-1] == len(ids)
    return got


cuts = st.lists(st.sampled_from(["a", "Wort", "fünf", "ñ", "×", "÷", "ɏ", "ʼ", "漢", "д", "²", "9", "12", "\n", "\n\n", " ", "  ", "\t", "\x1c", "\x7f", "\xa0", "\u2028", "\u3000", "\u0301", "'", "'s", "'ll", "_", ".", ",%", "(", "!'", "…", "–"]), max_size=10).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(odd, cuts, st.none()), max_size=6))
def test_columns_give_the_tokenizers_ids(texts):
    assert column_ids(encoder(PATH), texts) == [ids_of(t) + [2] for t in texts]


def test_columns_of_odd_texts(monkeypatch):
    texts = ["", None, " ", "\n", "a  b", "x \n y", " lead", "trail ", "<|endoftext|>", "a <|endoftext|>b", "é\n\né", "漢 漢", "ende.\n", "\nanfang", "it's 's '5 5's a1b2 (ä) ×3 ÷", "–\n–", *(chr(c) + "\n" + chr(c) + " " + chr(c) for c in range(1, 0x260))]
    want = [ids_of(t) + [2] for t in texts]
    for chunk in (1, 40, 8 << 20):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        assert column_ids(encoder(PATH), texts) == column_ids(encoder(PATH), texts, "large_string") == want
    assert column_ids(encoder(PATH), [None, ""]) == [[2], [2]] and column_ids(encoder(PATH), []) == []
    long = ["a.\n" * 50_000 + "b", "x\n" * 50_000, "漢 " * 50_000 + "!" * 50_000, "w" * 5000 + " " + "é" * 5000]
    assert column_ids(encoder(PATH), long) == [ids_of(t) + [2] for t in long]


def test_columns_take_each_new_word_once_and_many_at_a_time(monkeypatch):
    """A word is asked for once however often it occurs, in a few calls, and neither marks nor digits about it take it to the whole tokenizer."""

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, text, **options):
            asked.append(text)
            return self.inner.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            lines.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    enc, asked, lines = UnitEncoder(PATH), [], []
    enc.tokenizer, enc.words = Counted(enc.tokenizer), Counted(enc.words)
    names = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(10_000, 15_000)]
    texts = [" ".join(names), *(f"{n}.77@{n}.example, ({n})\n{n}### " for n in names)]
    for kept in (600_000, 0):
        monkeypatch.setattr(tokens, "MEMO_UNITS", kept)
        lines.clear()
        assert column_ids(enc, texts) == [ids_of(t) + [2] for t in texts]
        words = [w for line in lines for w in line.split(enc.letters[0xFF])]
        assert len(words) == len(set(words)) and len(lines) <= len(words) / tokens.WORDS + 1 and set(names[1:]) <= set(words)
        enc.plain.clear()
    assert not any(c.isalpha() for text in asked for c in text)


def test_memo_of_units_is_small():
    enc = UnitEncoder(PATH)
    for first in range(0, 650_000, 50_000):
        column_ids(enc, [" ".join("".join("abcdefghij"[int(d)] for d in str(k)) for k in range(1_000_000 + first, 1_050_000 + first))])
    assert sys.getsizeof(enc.plain) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in enc.plain.items()) < 64 << 20


def test_columns_without_a_byte_to_join_by():
    enc = UnitEncoder(PATH)
    enc.between = None
    texts = ["Erst.\nZweit fünft dritt%%%", "ein Wort"]
    assert column_ids(enc, texts) == [ids_of(t) + [2] for t in texts]


def test_a_long_text_of_short_lines():
    for text in ("a.\n" * 50_000 + "b", "x\n" * 50_000, "a!" * 50_000 + "\n" + "!" * 50_000):
        assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


def test_an_edit_touches_little(spark):
    text = " ".join(f"word{k}" for k in range(20_000))
    enc = encoder(PATH)
    doc = token_counts.CountedText(text, token_counts.leaves_of(text, enc), enc)
    doc.edit(len(text) // 2, 3, "changed here")
    assert doc.encoded < 200


def test_edit_tables(spark):
    docs = spark.createDataFrame([(1, 1, "some text here"), (2, 2, None), (3, 3, "left alone")], "uid long, doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 5, 4, "words"), (1, 0, 0, 0, "First "), (2, 0, 0, 0, "new"), (9, 0, 0, 0, "lost"), (1, 2, None, None, None)], "uid long, seq int, at long, delete long, insert string")
    trees = token_counts.build_trees(docs)
    got = {r.doc_id: r for r in token_counts.apply_edits(docs, trees, edits).collect()}
    first = "First some text here"
    first = first[:5] + "words" + first[9:]
    assert {i: got[i].text for i in got} == {1: first, 2: "new", 3: "left alone"}
    for r in got.values():
        assert r.n_tokens_after == len(ids_of(r.text)) == sum(r.leaf_tokens)
    assert (got[3].n_tokens, got[3].n_reencoded) == (len(ids_of("left alone")), 0)


def test_edited_counts_query(spark):
    rows = documents()
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_tokens_after) for r in token_counts.edited_counts(spark, frame(spark, rows)).collect())

    def after(t):
        t = t or ""
        n = len(t)
        for at, d, i in ((n // 3, 0, "edited text, "), (n // 2, 7, ""), (n * 3 // 4, 5, "Stra\u00dfe 42")):
            at = min(at, len(t))
            t = t[:at] + i + t[at + d :]
        return len(ids_of(t))

    assert got == sorted((i or -1, len(ids_of(t)), after(t)) for i, t in rows)
    assert token_counts.edited_counts(spark, frame(spark, [])).collect() == []


def test_token_files(spark):
    rows = documents()
    path = fresh_path(spark, "orc")
    token_orc.write_token_orc(spark, frame(spark, rows), path, stripe_mb=1, row_stride=1000)
    stored = token_orc.read_token_orc(spark, path)
    assert sorted((r.doc_id or -1, r.ids) for r in stored.collect()) == sorted((i or -1, ids_of(t) + [2]) for i, t in rows)
    got = token_orc.token_positions(spark, path).orderBy("start").collect()
    assert [r.doc_id or -1 for r in got] == sorted(i or -1 for i, _ in rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, crc(ids_of(t) + [2])) for i, t in rows)
    plan = stored.where("doc_id = 105")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,105)]" in plan


def test_point_lookups_skip_stripes(spark):
    """Stripes of a file whose ids cannot match are not read, and Bloom filters of the ids are in the files."""
    import glob

    import pyarrow.orc as orc

    path = fresh_path(spark, "orc")
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), x -> substr(sha2(concat(id, ':', x), 256), 1, 9))) AS text")
    token_orc.write_token_orc(spark, docs, path, stripe_mb=1, row_stride=1000)
    files = glob.glob(path.removeprefix("file://") + "/*.orc")
    stripes = sum(orc.ORCFile(f).nstripes for f in files)
    assert stripes > len(files)
    read = lambda i: token_orc.read_token_orc(spark, path).where(f"doc_id = {i}")
    assert [r.doc_id for r in read(20_000).collect()] == [20_000] and read(20_001).collect() == []
    scanned = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan())[1]

    def rows_read(plan):
        found = 0 if "Scan orc" not in plan.nodeName() else plan.metrics().apply("numOutputRows").value()
        return found + sum(rows_read(plan.children().apply(k)) for k in range(plan.children().size()))

    inner = lambda p: p.executedPlan() if "AdaptiveSparkPlan" in p.nodeName() else p
    one, none, every = (rows_read(inner(scanned(df))) for df in (read(20_000), read(20_001), token_orc.read_token_orc(spark, path)))
    assert every == 20_000 and 0 < one <= 1000  # one row group
    assert none == 0  # the id is within a row group's range, so only the Bloom filter can tell


def test_one_id_may_have_many_rows(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(7, "same")] * 50 + [(k, "x") for k in range(20)]
    path = fresh_path(spark, "orc")
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        token_orc.write_token_orc(spark, frame(spark, rows), path)
    stored = token_orc.read_token_orc(spark, path)
    parts = stored.where("doc_id IS NULL").groupBy("part").count().collect()
    assert len(parts) > 1
    got = token_orc.token_positions(spark, path).orderBy("start").collect()
    assert [r.doc_id or -1 for r in got] == sorted(i or -1 for i, _ in rows) and got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)


def test_token_files_empty(spark):
    assert token_orc.token_file_query(spark, frame(spark, [])).collect() == []


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, capacity):
    rows = documents()
    pieces = packing.pack(spark, frame(spark, rows), capacity=capacity).collect()
    expect, stored = defaultdict(list), defaultdict(list)
    for i, t in rows:
        expect[i].append(ids_of(t) + [0])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        stored[p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32].append(p)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(p.length for p in pieces) == sum(len(x) for xs in expect.values() for x in xs)
    for i, texts in expect.items():
        for ids in texts:
            for k in range(0, len(ids), capacity):
                part = ids[k : k + capacity]
                stored[i, len(ids), k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())].pop()
    padding = sum(packing.padding(sum(n for _, n in s), capacity) for s in sequences.values())
    assert padding <= 0.05 * sum(p.length for p in pieces)
    assert not any(stored.values())


def test_packing_empty(spark):
    assert packing.pack(spark, frame(spark, [])).collect() == []


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_padding_on_the_tables(spark, sf):
    """Under 1 % of all ids, and the linear program never loses to best-fit decreasing."""
    folder = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    pieces = packing.pack(spark, spark.read.parquet(folder))
    sums = pieces.groupBy("sequence_id").agg({"length": "sum"}).toPandas()["sum(length)"]
    assert sum(packing.padding(int(n), 1024) for n in sums) < 0.01 * sums.sum()


def test_patterns_beat_best_fit():
    for demand, capacity in (({342: 1000, 300: 900, 171: 777}, 1024), ({k: 40 for k in range(256, 513)}, 1024), ({k: 3 for k in range(1, 8192)}, 8192)):
        plan, plain = packing.plan_tails(demand, capacity), packing.best_fit(demand, capacity)
        used = defaultdict(int)
        for pattern, n in plan:
            assert sum(l * a for l, a in pattern.items()) <= capacity
            for l, a in pattern.items():
                used[l] += a * n
        assert used == demand
        assert packing._loss(plan, capacity) <= packing._loss(plain, capacity)
        if capacity == 1024:
            assert sum(n for _, n in plan) < 0.97 * sum(n for _, n in plain)


def test_column_generation_is_near_the_bound():
    rng = random.Random(2)
    demand = defaultdict(int)
    for _ in range(20_000):
        demand[rng.randint(1, 127)] += 1
    plan = packing.plan_tails(dict(demand), 128)
    used = defaultdict(int)
    for pattern, n in plan:
        assert sum(l * a for l, a in pattern.items()) <= 128
        for l, a in pattern.items():
            used[l] += a * n
    assert used == demand
    assert sum(n for _, n in plan) <= 1.01 * sum(l * n for l, n in demand.items()) / 128 + 1


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_columns_are_priced_at_every_size(spark, sf, monkeypatch):
    folder = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    pieces = packing.pack(spark, spark.read.parquet(folder)).where("length < 1024 AND start + length = doc_tokens")
    demand = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    calls, knapsack = [], packing.knapsack
    monkeypatch.setattr(packing, "knapsack", lambda *a: calls.append(1) or knapsack(*a))
    patterns = packing.column_generation(demand, 1024)
    volume = sum(l * n for l, n in demand.items()) / 1024
    assert calls and volume - 1e-6 <= sum(v for _, v in patterns) < volume + 1.5
    assert packing._loss(packing.plan_tails(demand, 1024), 1024) <= packing._loss(packing.best_fit(demand, 1024), 1024)
