import os
import random
import sys
import zlib

import numpy as np
import pytest
from cases import documents, frame, prose

from tallyloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
LARGER = "/root/testdata/check_s"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def held_out_accuracy(spark, scores, label, folder=SF):
    joined = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = joined["predicted"] == joined[label]
    return right.mean(), right[joined[label] == 1].mean(), right[joined[label] == 0].mean()


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    accuracy = held_out_accuracy(spark, quality.quality_scores(spark, docs, labels), "quality")
    assert min(accuracy) > 0.95


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    accuracy = held_out_accuracy(spark, toxicity.toxicity_scores(spark, docs, labels), "toxic")
    assert min(accuracy) > 0.9


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_toxicity_on_held_out_rows_with_enough_labels(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    accuracy = held_out_accuracy(spark, toxicity.toxicity_scores(spark, docs, labels), "toxic", LARGER)
    assert min(accuracy) > 0.95


@pytest.mark.parametrize("score, label, folds, out", [(quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)])
def test_odd_rows(spark, score, label, folds, out):
    rng = random.Random(3)
    rows = documents() + [(2000 + k, prose(rng, 40) + (" idiot !!" if k % 2 else "")) for k in range(60)]
    labels = spark.createDataFrame([(2000 + k, k % 2, k % 2) for k in range(60)] + [(None, 1, 1), (101, None, None), (2000, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(spark, frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out)
    assert score(spark, frame(spark, []), labels).collect() == []
    no_labels = score(spark, frame(spark, rows), labels.limit(0)).collect()
    assert len(no_labels) == len(rows)


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 30)) for k in range(80)]
    held = lambda k, folds, out: zlib.crc32(str(k).encode()) % folds == out
    for score, folds, out in ((quality.quality_scores, 3, 1), (toxicity.toxicity_scores, 5, 0)):
        a, b = (
            score(spark, frame(spark, rows), spark.createDataFrame([(k, x := (k % 2 if not held(k, folds, out) else flip), x) for k, _ in rows], "doc_id long, quality int, toxic int"))
            .orderBy("doc_id").collect() for flip in (0, 1)
        )
        assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-6)


def test_signs_spread_over_a_text_add_up():
    rng = random.Random(5)
    rows = [(prose(rng, 60) + (" zorrax " if k % 2 else " ") + prose(rng, 60), k % 2) for k in range(200)]
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], 0.5)
    plain = prose(rng, 64)
    marked = " ".join("zorrax" if k == 20 else w for k, w in enumerate(plain.split()))
    one, four = toxicity.Scorer(model).logits([" ".join([marked] + [plain] * 3), " ".join([marked] * 4)])
    assert four > one + 1


def plain_logit(model, text):
    """A document's logit with loops over numbers only: embeddings, two GRUs, attention, evidence of all windows."""
    import math
    import re

    p = {k: v.tolist() for k, v in model.p.items()}
    words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    sig, size = (lambda x: 1 / (1 + math.exp(-x))), toxicity.STATE

    def embed(w):
        padded = b" " + w + b" "
        grams = [((padded[i] << 16) + (padded[i + 1] << 8) + padded[i + 2]) * 2654435761 % 2**32 * toxicity.TRIGRAMS >> 32 for i in range(len(w))]
        stems = [zlib.crc32(w[:k], 1) % toxicity.STEMS for k in toxicity.BEGIN if k <= len(w)] or [zlib.crc32(w, 1) % toxicity.STEMS]
        mean = lambda rows: [sum(c) / len(rows) for c in zip(*rows)]
        return p["words"][zlib.crc32(w) % toxicity.WORDS] + mean([p["chars"][g] for g in grams]) + mean([p["stems"][s] for s in stems])

    def gru(xs, side):
        h, out = [0.0] * size, []
        for x in xs:
            xw = [sum(a * w[j] for a, w in zip(x, p["w" + side])) + p["c" + side][j] for j in range(3 * size)]
            hu = [sum(a * u[j] for a, u in zip(h, p["u" + side])) for j in range(3 * size)]
            z = [sig(xw[j] + hu[j]) for j in range(size)]
            g = [sig(xw[size + j] + hu[size + j]) for j in range(size)]
            c = [math.tanh(xw[2 * size + j] + g[j] * hu[2 * size + j]) for j in range(size)]
            h = [a + b * (d - a) for a, b, d in zip(h, z, c)]
            out.append(h)
        return out

    total = p["base"][0]
    for start, n in toxicity.windows_of(len(words)):
        xs = [embed(w) for w in words[start : start + n]]
        states = [a + b for a, b in zip(gru(xs, "f"), gru(xs[::-1], "b")[::-1])] or [[0.0] * (2 * size)]
        e = [math.exp(sum(a * b for a, b in zip(s, p["v"]))) for s in states]
        pooled = [sum(w * s[j] for w, s in zip(e, states)) / sum(e) for j in range(2 * size)]
        logit = sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0]
        total += math.log1p(math.exp(-abs(logit))) + max(logit, 0)
    return total


def test_toxicity_scores_against_plain_loops(spark):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in documents() if i is not None and i != 100]
    known = [(prose(random.Random(k), 40) + (" idiot" if k % 2 else ""), k % 2) for k in range(60)]
    model = toxicity.train([t for t, _ in known], [y for _, y in known], 0.5, rounds=2)
    got = {r.doc_id: r.score for r in frame(spark, rows).select("doc_id", "text").mapInArrow(toxicity._scores(model, size=7), "doc_id long, score double").collect()}
    for i, t in rows:
        logit = model.slope * min(max(plain_logit(model, t), -30), 30) + model.shift
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-4, (i, t)


def test_quality_scores_against_plain_loops(spark):
    """Random indexing, pooling and the two layers again, word by word."""
    rows = [(i, t) for i, t in documents() if i is not None and i != 100]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    vectors, network = quality.fit(df.select("doc_id", "text"), labels, quality.fold(quality.F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.score for r in quality.quality_scores(spark, df, labels).collect()}
    place, sign = quality._index()
    n = quality.LEXICAL + quality.SHAPES
    table = np.zeros((n, quality.DIM))

    def add(of, by):
        for k, s in zip(place[by], sign[by]):
            table[of, k] += s

    for _, t in rows:
        pairs = [quality._buckets(w) for w in (t or "").split()]
        for k, (word, shape) in enumerate(pairs):
            for other in ([pairs[k - 1][0]] if k else []) + ([pairs[k + 1][0]] if k + 1 < len(pairs) else []):
                add(word, other)
            add(shape, word)
            add(word, shape)
    table = [row / max(np.sqrt((row * row).sum()), 1e-6) for row in table]
    assert np.allclose(table, vectors, atol=1e-5)
    for i, t in rows:
        pairs = [quality._buckets(w) for w in (t or "").split()]
        x = np.zeros(3 * quality.DIM + 4)
        if pairs:
            v, s = [table[w] for w, _ in pairs], [table[h] for _, h in pairs]
            mean = sum(v) / len(v)
            x[: quality.DIM], x[quality.DIM : 2 * quality.DIM] = mean, sum(s) / len(s)
            x[2 * quality.DIM : 3 * quality.DIM] = np.sqrt(np.maximum(sum(a * a for a in v) / len(v) - mean**2, 0))
            x[-4] = sum((a * b).sum() for a, b in zip(v, v[1:])) / len(v)
            x[-3] = sum(a[0] == b[0] for a, b in zip(pairs, pairs[1:])) / len(v)
            x[-2] = np.sqrt((mean * mean).sum())
        x[-1] = np.log1p(len(pairs)) / 5
        hidden = [np.tanh(sum((x - network.mean) / network.scale * network.w1[:, j]) + network.b1[j]) for j in range(len(network.b1))]
        logit = sum(h * w for h, w in zip(hidden, network.w2)) + network.b2
        assert abs(got[i] - 1 / (1 + np.exp(-logit / network.temperature))) < 1e-3, (i, t)


def test_shapes_are_of_whole_tokens():
    shape = lambda token: quality._buckets(token)[1]
    assert shape("漢" * 100 + "!42") == shape("漢!42") != shape("漢" * 100)


def test_memo_of_tokens_is_small_and_starts_over():
    size = lambda memo: sys.getsizeof(memo) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memo.items())
    for first in range(0, 450_000, 1000):
        tokens = [f"Token-{first + k}" for k in range(1000)]
        word, shape, sizes = quality._tokens([" ".join(tokens)])
        assert size(quality._memo) < 32 << 20 if first % 150_000 == 149_000 else sizes.tolist() == [1000]
        assert (word[-1], shape[-1]) == quality._buckets(tokens[-1]) and tokens[-1] in quality._memo


def test_windows_cover_whole_texts():
    for n in range(0, 300):
        spans = toxicity.windows_of(n)
        assert {i for s, m in spans for i in range(s, s + m)} == set(range(n))
        assert all(m <= toxicity.WINDOW for _, m in spans)


def test_gradients():
    rng = np.random.default_rng(0)
    model = toxicity.Recurrent()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    encoded = toxicity.encode_words([b"abc", b"loser", b"zz", "é".encode()])
    index, mask = rng.integers(0, 4, (5, 6)), np.arange(6) < np.array([6, 4, 2, 1, 6])[:, None]
    y, w = np.array([0, 1, 1, 0, 1.0]), np.full(5, 0.2)
    _, grad = model.gradients(encoded, index, mask, y, w)
    for name, g in grad.items():
        at, flat = np.abs(g).argmax(), model.p[name].ravel()
        old, loss = flat[at], []
        for step in (1e-3, -1e-3):
            flat[at] = old + step
            loss.append(model.gradients(encoded, index, mask, y, w)[0])
        flat[at] = old
        assert np.isclose(g.ravel()[at], (loss[0] - loss[1]) / 2e-3, rtol=1e-2, atol=1e-5), name


def test_best_spans_against_plain_sums():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 200, 6)
        doc, evidence = np.repeat(np.arange(6), sizes), rng.random(int(sizes.sum())) ** 4
        best, inside = toxicity.best_spans(evidence, doc)
        for d in range(6):
            e = evidence[doc == d]
            sums = {(a, b): e[a:b].sum() for a in range(len(e)) for b in [min(a + toxicity.SPAN, len(e))]}
            assert np.isclose(best[d], max(sums.values())) and np.isclose(e[inside[doc == d]].sum(), best[d]) and inside[doc == d].sum() <= toxicity.SPAN


@needs_tables
def test_length_alone_makes_no_text_toxic(spark):
    """Clean held-out rows joined to texts of up to 300,000 words stay clean; one toxic row in such a text is found."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.fit(docs, labels, quality.fold(toxicity.F.col("doc_id"), 5) != 0))
    held = docs.join(labels, "doc_id").where(quality.fold(toxicity.F.col("doc_id"), 5) == 0).orderBy("doc_id").toPandas()
    held["score"] = np.concatenate([scorer.score(held["text"].iloc[k : k + 64].tolist()) for k in range(0, len(held), 64)])
    clean = held[(held["toxic"] == 0) & (held["score"] < 0.2)]["text"].tolist()
    toxic = held[(held["toxic"] == 1) & (held["score"] >= 0.5)]["text"].tolist()
    random.Random(1).shuffle(clean)
    words = " ".join(clean).split()
    while len(words) < 300_000:
        words += words
    for n in (100, 3_000, 10_000, 45_000, 120_000, 300_000):
        assert scorer.score([" ".join(words[:n])])[0] < 0.5
    found = [scorer.score([" ".join([*words[:20_000], text, *words[20_000:40_000]])])[0] >= 0.5 for text in toxic[:30]]
    assert np.mean(found) > 0.95
