import hashlib
import random
import re
from collections import Counter

import numpy as np
from cases import documents, frame, prose, unique

from tallyloom.llm import decontaminate, minhash, repeats, url_filters


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_decontaminate(spark):
    rng = random.Random(5)
    rows = documents()
    long = rows[0][1] or prose(rng, 50)
    base = next(t for _, t in rows if t and len(t.split()) > 60)
    items = [(20, "alpha"), (21, "one two words"), (1, " ".join(base.split()[10:40])), (2, "TWO, words!"), (3, None), (4, ""), (5, "..."), (6, prose(rng, 40)), (7, "one"), (2, "TWO words"), (None, "twice"), (8, long)]
    got = decontaminate.contamination(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    expect = []
    for d, t in rows:
        w, hit, who = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    who |= windows[tuple(w[k : k + size])]
        names = sorted(str(x) for x in who if x is not None)
        expect.append((d or -1, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(expect)
    assert any(x[5] for x in expect) and not all(x[5] for x in expect)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(spark, frame(spark, documents()), none).collect()} == {False}
    assert decontaminate.contamination(spark, frame(spark, []), none).collect() == []


def test_repeats(spark):
    rows = documents()
    got = repeats.remove_repeats(spark, frame(spark, rows)).collect()
    count = Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    expect = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        expect.append((d or -1, len(b), int(gone[: len(b)].sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(expect)
    assert repeats.remove_repeats(spark, frame(spark, [])).collect() == []


def test_cover_is_a_perfect_difference_set():
    d = repeats.cover()
    assert len(d) == 12 and sorted((x - y) % repeats.PERIOD for x in d for y in d if x != y) == list(range(1, repeats.PERIOD))


def test_blocks_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.r_[rng.integers(0, 4, 3000), np.zeros(900, int), rng.integers(0, 256, 2000)].astype(np.uint8).tobytes()
    texts = [b"", data, data[:199], data[:200], data[:701], data[5:3000], b"x" * 700]
    wholes = []
    for segment in (700, 1 << 18):
        repeats._powers.cache_clear()
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        wholes.append(repeats.blocks_of(texts))
        parts = [repeats.blocks_of(texts, only=(k, 3)) for k in range(3)]
        assert sorted(x for p in parts for x in zip(*p)) == sorted(zip(*wholes[-1]))
        assert sorted(repeats.blocks_of(texts, names=False)[0]) == sorted(wholes[-1][4])
    assert all((a == b).all() for a, b in zip(*wholes))
    assert {(k, p) for k, p in zip(*wholes[0][:2])} == {(k, p) for k, t in enumerate(texts) if len(t) >= 200 for p in range(len(t) - 67) if p % repeats.PERIOD in repeats.cover()}
    repeats._powers.cache_clear()


def test_repeats_of_all_kinds(spark):
    """Copies at every remainder, of 199 to 210 bytes and more, overlapping, cut by text ends, many at once."""
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(700)
    rows = [(k, text(rng.randint(0, 150)) + shared[(a := rng.randint(0, 450)) : a + rng.choice([199, 200, 201, 210, 250])] + text(rng.randint(0, 150))) for k in range(60)]
    rows += [(100 + k, shared[: 200 + k]) for k in range(4)] + [(110, shared), (111, shared[1:]), (112, "z" * 600), (113, "yz" * 260), (114, text(300) + shared + shared + text(40))]
    got = repeats.remove_repeats(spark, frame(spark, rows), passes=3).collect()
    count = Counter(b[i : i + 200] for _, t in rows for b in [t.encode()] for i in range(len(b) - 199))
    for r in got:
        b = dict(rows)[r.doc_id].encode()
        gone = {i + j for i in range(len(b) - 199) if count[b[i : i + 200]] > 1 for j in range(200)}
        assert r.n_removed == len(gone), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()


def bag(text):
    w = words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    """Brute force: components of pairs with multiset Jaccard of at least 0.8."""
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            union = sum((bags[a] | bags[b]).values())
            if union and sum((bags[a] & bags[b]).values()) >= 0.8 * union:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(tuple(sorted(-1 if i is None else i for i in g)) for g in groups.values())


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = documents()
    base = prose(rng, 120).split()
    for k in range(60):  # one group whose members differ from each other more than from the first
        w = list(base)
        for _ in range(k % 4):
            w[rng.randint(0, 119)] = f"edit{rng.random()}"
        rows.append((1000 + k, " ".join(w)))
    got = minhash.near_duplicates(spark, frame(spark, rows)).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.class_id, r.uid if r.class_size == 1 else None), []).append(-1 if r.doc_id is None else r.doc_id)
        assert r.class_size >= 1
    mine = sorted(tuple(sorted(g)) for g in groups.values())
    assert mine == classes(rows)


def test_near_duplicates_exhaustive_step(spark):
    rng = random.Random(10)
    base = prose(rng, 100).split()
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(3):
            w[rng.randint(0, 99)] = f"edit{rng.random()}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark, frame(spark, rows), rounds=0).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in groups.values()) == classes(rows)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Hot buckets: many members, most of them unlike each other, some linked only through others."""
    monkeypatch.setattr(minhash, "SMALL", 5)
    monkeypatch.setattr(minhash, "BLOCK", 24)
    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randint(0, 119)] = f"edit{rng.random()}"
        rows.append((k, " ".join(w)))
    expect = classes(rows)
    assert 20 < len(expect) < 150 and max(map(len, expect)) > 5
    for rounds in (0, 1):
        groups = {}
        for r in minhash.near_duplicates(spark, frame(spark, rows), rounds=rounds).collect():
            groups.setdefault(r.class_id, []).append(r.doc_id)
        assert sorted(tuple(sorted(g)) for g in groups.values()) == expect


def test_a_bucket_of_unlike_members_gives_no_pairs():
    """One band shared by a thousand documents that are alike by half: the block step returns links only."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    n, shared = 1000, rng.integers(0, 1 << 60, 50)
    ids = [np.r_[shared, rng.integers(0, 1 << 60, 50)] for _ in range(n)]
    ids[500] = np.r_[ids[400][:99], ids[500][99:]]
    columns = {
        "key": np.full(n, 7), "uid": np.arange(n), "comp": np.arange(n), "size": np.full(n, 100), "side": np.zeros(n, np.int32),
        "keys": pa.array([[7] * 24] * n), "sig": pa.nulls(n, pa.binary()), "ids": pa.array([i.tolist() for i in ids]),
    }
    got = minhash._blocks(96, 0.5, 0.8)(pa.table(columns)).to_pylist()
    assert got == [{"a": 400, "b": 500, "sure": True}]


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(spark, frame(spark, [])).collect() == []


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for low, high in ((1, 2), (1, 6)):
        h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = rng.integers(low, high, 300), rng.integers(low, high, 300)
        a[:40], b[260:] = 0, 0
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        n = 2048
        sig = [minhash.signature(h[w > 0], w[w > 0], n) for w in (a, b)]
        assert abs((sig[0] == sig[1]).mean() - exact) < 4 * (exact * (1 - exact) / n) ** 0.5


def test_url_filters(spark):
    pages = [
        (1, "http://a.NET/x"), (2, "http://example.net/en/a"), (3, "http://x.example.com/de/"), (4, "http://example.com/den"), (5, "http://y.org/fr/?q"),
        (6, None), (7, "no scheme"), (8, "http://net"), (9, "http://notexample.net/en/"), (9, "http://notexample.net/en/"), (None, "a://net/#f"), (11, "u://b://net/"), (12, "http://a.net?x/"), (13, "://net/a\nb"), (14, "http://" + "a." * 10_000 + "example.net/en/" + "p" * 10_000), (15, "http://" + "." * 50 + "net/"),
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, rule string")
    got = [(r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in url_filters.apply_rules(df, url_filters.rule_frame(spark)).collect()]

    def expect(i, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return (i or -1, host, path, best[1], best[2])

    assert sorted(got, key=str) == sorted((expect(i, u) for i, u in pages), key=str)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_filters.apply_rules(df, none).collect()} == {"allow"}
    assert url_filters.apply_rules(df.limit(0), url_filters.rule_frame(spark)).collect() == []


def test_unique_rows_only():
    rows = unique(documents())
    assert len({i for i, _ in rows}) == len(rows)


def test_register_gate_misses_far_less_than_the_bands():
    from math import comb

    need = int(np.ceil(minhash.least_alike(0.8, 96) * 96))
    assert sum(comb(96, k) * 0.8**k * 0.2 ** (96 - k) for k in range(need)) < 3.2e-8


def test_recall_against_all_pairs_of_a_table(spark):
    """Every row whose id is divisible by 5 (RECALL_STEP) against all rows: pairs of similarity 0.8 and more are in one class."""
    import os

    import pytest

    folder, step = os.environ.get("RECALL_DIR", "/root/testdata/sf0.01"), int(os.environ.get("RECALL_STEP", "5"))
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    ids = np.array([r.doc_id for r in rows])
    bags = [minhash.numbered(b) for b in minhash.bags([r.text for r in rows])]
    size = np.array([len(b) for b in bags])
    _, code = np.unique(np.concatenate(bags), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(code, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(code))]
    ends = np.cumsum(size)
    of = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark, docs).collect()}
    pairs = found = 0
    for q in np.flatnonzero(ids % step == 0):
        if not size[q]:
            continue
        mine = code[ends[q] - size[q] : ends[q]]
        both = np.bincount(np.concatenate([owner[order[start[c] : start[c + 1]]] for c in mine]), minlength=len(rows))
        alike = np.flatnonzero(both >= 0.8 * (size[q] + size - both) - 1e-9)
        pairs += len(alike) - 1
        found += sum(of[ids[k]] == of[ids[q]] for k in alike) - 1
    print("pairs", pairs, "found", found)
    assert pairs > 10 and found == pairs
