"""Toxicity (operator 2): a bidirectional gated recurrent network with attention pooling.

Inputs of a step are a word embedding (hashed) and the means of the embeddings (hashed) of the
word's character trigrams and of its beginnings, which inflected words share. Forward and backward GRU states are pooled by attention to one logit a
window. Every overlapping window of a whole text is scored; a window's evidence is the softplus
of its logit. A base plus the largest sum of the evidence of SPAN windows that follow each other,
less a little for texts of many spans, calibrated, is the document's logit: signs add up within
a passage, but a long text is not toxic for its length. Training is numpy, on a bounded labelled sample and on the same sum: each
round scores all windows, and those of a document's span that weigh most get gradients while the
others' evidence is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.quality import fold, labelled_sample
from tallyloom.llm.words import words

WINDOW, STRIDE = 32, 16
#: Windows of a passage: about five hundred words. A text of many passages has to show more in its best one, by this times
#: the logarithm of their number, as the best of many clean ones is higher too.
SPAN, MANY = 32, 0.25
#: Hash buckets of words, of character trigrams and of beginnings; sizes of their embeddings and of a GRU state.
WORDS, TRIGRAMS, STEMS, WORD_DIM, CHAR_DIM, STEM_DIM, STATE = 16_384, 4096, 16_384, 6, 10, 8, 8
#: Bytes of a beginning; a shorter word is its own.
BEGIN = (4, 5, 6, 7, 8)
#: Bounds on the labelled rows used, of each label; the smallest hashes of the id are taken.
FIT_TOXIC, FIT_CLEAN = 1500, 1500
MEMO = 150_000
CHUNK = 2048
#: Windows of a document that get gradients in a round, besides one drawn by lot.
TELLING = 12
#: Documents of one step of the training.
DOCS = 24
#: Training documents below which a word's or a beginning's bucket is not learned; rows added to smooth log odds.
RARE, SMOOTH = 4, 4.0


def encode_words(distinct: list[bytes]):
    """Word buckets, and the buckets of trigrams and of beginnings of all words with each word's start and number."""
    import zlib

    import numpy as np

    word = np.fromiter((zlib.crc32(w) for w in distinct), np.int64, len(distinct)) % WORDS
    buffer = np.frombuffer(b"".join(b" " + w + b" " for w in distinct), np.uint8).astype(np.int64)
    size = np.fromiter((len(w) for w in distinct), np.int64, len(distinct))
    starts = np.cumsum(size + 2) - (size + 2)
    code = ((buffer[:-2] << 16) + (buffer[1:-1] << 8) + buffer[2:]) * 2654435761 % (1 << 32) * TRIGRAMS >> 32
    keep = np.ones(len(buffer), bool)  # a word of n bytes has n trigrams
    keep[starts + size] = keep[starts + size + 1] = False
    begin = [[w[:k] for k in BEGIN if k <= len(w)] or [w] for w in distinct]
    many = np.fromiter(map(len, begin), np.int64, len(distinct))
    stem = np.fromiter((zlib.crc32(b, 1) for some in begin for b in some), np.int64, int(many.sum())) % STEMS
    return word, code[keep[:-2]], np.cumsum(size) - size, size, stem, np.cumsum(many) - many, many


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, length) of the overlapping windows that cover n words."""
    if n <= WINDOW:
        return [(0, n)]
    return [(s, min(WINDOW, n - s)) for s in range(0, n - WINDOW + STRIDE, STRIDE)]


def _sigmoid(x):
    import numpy as np

    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _softplus(x):
    import numpy as np

    return np.logaddexp(0, x)


class Recurrent:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 3) -> None:
        import numpy as np

        rng, f = np.random.default_rng(seed), np.float32
        inputs = WORD_DIM + CHAR_DIM + STEM_DIM
        self.p = {
            "words": rng.normal(0, 0.3, (WORDS, WORD_DIM)).astype(f), "chars": rng.normal(0, 0.6, (TRIGRAMS, CHAR_DIM)).astype(f),
            "stems": rng.normal(0, 0.5, (STEMS, STEM_DIM)).astype(f),
            "v": rng.normal(0, 0.5, 2 * STATE).astype(f), "out": rng.normal(0, 0.5, 2 * STATE).astype(f),
            "bias": np.full(1, -3, f), "base": np.full(1, -1, f),
        }
        for side in "fb":
            self.p["w" + side] = rng.normal(0, inputs**-0.5, (inputs, 3 * STATE)).astype(f)
            self.p["u" + side] = rng.normal(0, STATE**-0.5, (STATE, 3 * STATE)).astype(f)
            self.p["c" + side] = np.zeros(3 * STATE, f)
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, encoded):
        """The step inputs of distinct words."""
        import numpy as np

        word, code, starts, size, stem, begins, many = encoded
        chars = np.add.reduceat(self.p["chars"][code], starts) / size[:, None].astype(np.float32)
        stems = np.add.reduceat(self.p["stems"][stem], begins) / many[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][word], chars, stems], axis=1)

    def gates(self, x):
        """Both directions' input projections, (words x 6 states)."""
        import numpy as np

        return np.concatenate([x @ self.p["w" + s] + self.p["c" + s] for s in "fb"], axis=1)

    def run(self, gates, index, mask, keep: bool = False):
        """Logits of windows; index (windows x steps) into gates, mask 1 where there is a word."""
        import numpy as np

        n, steps = index.shape
        h_all, kept = np.empty((steps, n, 2 * STATE), np.float32), {}
        for side, lo in (("f", 0), ("b", STATE)):
            h, u, at = np.zeros((n, STATE), np.float32), self.p["u" + side], 3 * lo
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                x = gates[index[:, t], at : at + 3 * STATE]
                r = h @ u
                zr = _sigmoid(x[:, : 2 * STATE] + r[:, : 2 * STATE])
                z, g = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[:, 2 * STATE :] + g * r[:, 2 * STATE :])
                before = h
                h = np.where(mask[:, t, None], h + z * (c - h), h)
                h_all[t, :, lo : lo + STATE] = h
                if keep:
                    kept[side, t] = (before, z, g, c, r[:, 2 * STATE :])
        e = np.where(mask.T, h_all @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, h_all)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (h_all, kept, a, pooled)) if keep else logit

    def pool(self, logit, doc, n: int):
        """Logits of n documents, of which each has windows in `doc`, in order: the base and the evidence of the best span."""
        import numpy as np

        spans = np.maximum(np.bincount(doc, minlength=n) / SPAN, 1)
        return self.p["base"][0] + best_spans(_softplus(logit.astype(float)), doc)[0] - MANY * np.log(spans)

    def gradients(self, encoded, index, mask, y, weight, doc=None, rest=0.0):
        """Loss and gradients of the weighted log loss: of windows, or of documents with `doc` naming each window's.

        `rest` is the evidence of the documents' spans in windows that are not among these.
        """
        import numpy as np

        x = self.inputs(encoded)
        gates = self.gates(x)
        logit, (h_all, kept, a, pooled) = self.run(gates, index, mask, keep=True)
        grad = {k: np.zeros_like(q) for k, q in self.p.items()}
        total_logit = logit if doc is None else self.p["base"][0] + np.bincount(doc, _softplus(logit.astype(float)), len(y)) + rest
        d = ((_sigmoid(total_logit) - y) * weight).astype(np.float32)
        if doc is not None:
            grad["base"] = d.sum(keepdims=True)
            d = (d[doc] * _sigmoid(logit)).astype(np.float32)
        grad["out"], grad["bias"] = pooled.T @ d, d.sum(keepdims=True)
        d_pool = d[:, None] * self.p["out"]
        d_a = np.einsum("nk,tnk->tn", d_pool, h_all)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        grad["v"] = np.einsum("tn,tnk->k", d_e, h_all)
        d_h = a[:, :, None] * d_pool + d_e[:, :, None] * self.p["v"]
        d_gates = np.zeros_like(gates)
        steps = index.shape[1]
        for side, lo in (("f", 0), ("b", STATE)):
            u, at, back = self.p["u" + side], 3 * lo, np.zeros((len(index), STATE), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                before, z, g, c, rc = kept[side, t]
                total = (back + d_h[t, :, lo : lo + STATE]) * mask[:, t, None]
                skip = (back + d_h[t, :, lo : lo + STATE]) - total
                d_c = total * z * (1 - c * c)
                d_r = np.concatenate([total * (c - before) * z * (1 - z), d_c * rc * g * (1 - g)], axis=1)
                d_u = np.concatenate([d_r, d_c * g], axis=1)
                grad["u" + side] += before.T @ d_u
                back = total * (1 - z) + d_u @ u.T + skip
                np.add.at(d_gates, (index[:, t], slice(at, at + 3 * STATE)), np.concatenate([d_r, d_c], axis=1))
        d_x = np.zeros_like(x)
        for side, at in (("f", 0), ("b", 3 * STATE)):
            dg = d_gates[:, at : at + 3 * STATE]
            grad["w" + side], grad["c" + side] = x.T @ dg, dg.sum(axis=0)
            d_x += dg @ self.p["w" + side].T
        word, code, _, size, stem, _, many = encoded
        d_word, d_chars, d_stems = np.split(d_x, [WORD_DIM, WORD_DIM + CHAR_DIM], axis=1)
        np.add.at(grad["words"], word, d_word)
        np.add.at(grad["chars"], code, np.repeat(d_chars / size[:, None].astype(np.float32), size, axis=0))
        np.add.at(grad["stems"], stem, np.repeat(d_stems / many[:, None].astype(np.float32), many, axis=0))
        loss = (np.logaddexp(0, np.where(y > 0.5, -total_logit, total_logit)) * weight).sum()
        return float(loss), grad


def best_spans(evidence, doc):
    """For each document the greatest sum of evidence of at most SPAN windows in a row, and which windows are in it.

    doc: each window's document, ascending from 0, none without windows.
    """
    import numpy as np

    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    before = np.concatenate([[0.0], np.cumsum(evidence)])
    end = np.arange(1, len(doc) + 1)
    begin = np.maximum(end - SPAN, starts[doc])
    total = before[end] - before[begin]
    best = np.maximum.reduceat(total, starts)
    last = np.full(len(starts), len(doc))
    hit = np.flatnonzero(total == best[doc])
    np.minimum.at(last, doc[hit], hit)  # the first of equal ones
    at = np.arange(len(doc))
    return best, (at <= last[doc]) & (at >= begin[last][doc])


def _window_arrays(flat, sizes):
    """All windows of documents given as word numbers, one after the other: index, mask, the window's document."""
    import numpy as np

    many = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW + STRIDE) // STRIDE))  # windows_of()
    doc = np.repeat(np.arange(len(sizes)), many)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    start = (np.cumsum(sizes) - sizes)[doc] + at
    step = np.arange(WINDOW)
    mask = step < np.minimum(WINDOW, sizes[doc] - at)[:, None]
    index = np.where(mask, np.minimum(start[:, None] + step, max(len(flat) - 1, 0)), 0)
    return (flat[index] if len(flat) else np.zeros_like(index)), mask, doc


class Scorer:
    """Scores texts with a trained network; gates of frequent words are kept per worker."""

    def __init__(self, model: Recurrent) -> None:
        import numpy as np

        self.model, self.place = model, {}
        self.gates = np.zeros((0, 6 * STATE), np.float32)

    def logits(self, texts: list[str | None]):
        import numpy as np

        many = [words(t) for t in texts]
        every = [w for doc in many for w in doc]
        fresh = list(set(every) - self.place.keys())
        if len(self.place) + len(fresh) > MEMO:
            self.place, self.gates = {}, self.gates[:0]
            fresh = list(set(every))
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.gates = np.concatenate([self.gates, self.model.gates(self.model.inputs(encode_words(fresh)))])
        gates = self.gates if len(self.gates) else np.zeros((1, 6 * STATE), np.float32)
        flat = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        index, mask, doc = _window_arrays(flat, np.array([len(d) for d in many], np.int64))
        logit = np.concatenate([self.model.run(gates, index[k : k + CHUNK], mask[k : k + CHUNK]) for k in range(0, len(index), CHUNK)])
        return self.model.pool(logit, doc, len(texts))

    def score(self, texts):
        import numpy as np

        logit = np.clip(self.logits(texts), -30, 30)
        return 1 / (1 + np.exp(-np.clip(self.model.slope * logit + self.model.shift, -60, 60)))


def train(texts: list[str | None], labels, prior: float, rounds: int = 8, seed: int = 3) -> Recurrent:
    """A network from documents' labels; prior is the share of label 1 among all labelled documents."""
    import numpy as np

    model, rng, y = Recurrent(seed), np.random.default_rng(seed), np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        model.shift = 0.0 if len(y) == 0 else float(np.where(y[0] > 0.5, 4, -4))
        model.slope = 0.0
        return model
    many = [words(t) for t in texts]
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[: len(y) // 5]] = True
    number: dict[bytes, int] = {}
    docs = [[number.setdefault(w, len(number)) for w in d] for d in many]
    distinct = list(number) or [b"x"]
    flat = np.fromiter((x for d in docs for x in d), np.int64, sum(map(len, docs)))
    index, mask, doc = _window_arrays(flat, np.array([len(d) for d in docs], np.int64))
    # Log odds between the labels (documents of the training part are counted) start the embeddings and choose windows.
    word, _, _, _, stem, _, many_stems = encode_words(distinct)
    seen_words, seen_stems = np.zeros((2, WORDS)), np.zeros((2, STEMS))
    at = np.cumsum(many_stems) - many_stems
    for k in np.flatnonzero(~held):
        of = np.unique(np.array(docs[k], np.int64))
        if len(of):
            seen_words[int(y[k]), np.unique(word[of])] += 1
            seen_stems[int(y[k]), np.unique(np.concatenate([stem[at[i] : at[i] + many_stems[i]] for i in of]))] += 1
    fixed = {}
    total = np.maximum([(y[~held] == 0).sum(), (y[~held] == 1).sum()], 1)[:, None]
    for name, seen in (("words", seen_words), ("stems", seen_stems)):
        expect = total / total.sum() * SMOOTH
        odds = np.log((seen + expect) / (total + expect))
        odds = odds[1] - odds[0]
        fixed[name] = seen.sum(axis=0) < RARE
        model.p[name][fixed[name]] = 0  # too rare to learn from, as are words never seen
        model.p[name][:, 0] = np.where(fixed[name], 0, odds)
    best_stem = np.maximum.reduceat(model.p["stems"][stem, 0], at)
    rank = np.where(mask, np.maximum(model.p["words"][word, 0], best_stem)[index], -1e9).max(axis=1)
    evidence = np.zeros(len(doc))
    state = {k: (np.zeros_like(q), np.zeros_like(q)) for k, q in model.p.items()}
    t, size = 0, np.bincount(doc, minlength=len(y))
    starts = np.cumsum(size) - size
    least, best = np.inf, None
    for r in range(rounds + 1):
        if r > 0:
            rank = _all_logits(model, distinct, index, mask)
            evidence = _softplus(rank.astype(float))
            z = np.clip(model.pool(rank, doc, len(y)), -30, 30)
            loss, *line = _calibration(z[held], y[held])
            if loss < least:  # the round that does best on the held fifth is kept
                least, best = loss, ({k: q.copy() for k, q in model.p.items()}, *line)
        if r == rounds:
            break
        _, inside = best_spans(evidence if r > 0 else np.maximum(rank, 0), doc)
        first = np.full(len(y), len(doc))  # window of each span
        np.minimum.at(first, doc[inside], np.flatnonzero(inside))
        by = np.lexsort([-(rank + rng.normal(0, 1e-3, len(rank))), ~inside, doc])
        place = np.empty(len(doc), np.int64)  # of a window in its document, the most telling of the span first
        place[by] = np.arange(len(doc)) - starts[doc[by]]
        use = inside & (place < TELLING)
        use[first + rng.integers(0, np.bincount(doc, inside).astype(np.int64))] = True
        rest = np.bincount(doc, np.where(inside & ~use, evidence, 0), len(y))
        some = np.flatnonzero(~held)
        rng.shuffle(some)
        for k in range(0, len(some), DOCS):
            batch = some[k : k + DOCS]
            rows = np.concatenate([starts[d] + np.flatnonzero(use[starts[d] : starts[d] + size[d]]) for d in batch])
            own = np.repeat(np.arange(len(batch)), [use[starts[d] : starts[d] + size[d]].sum() for d in batch])
            local, back = np.unique(index[rows], return_inverse=True)
            encoded = encode_words([distinct[i] for i in local])
            weight = np.full(len(batch), 1 / len(batch))
            _, grad = model.gradients(encoded, back.reshape(len(rows), -1), mask[rows], y[batch], weight, own, rest[batch])
            t += 1
            rate = 0.012 * (1 - 0.85 * r / rounds)
            for name, g in grad.items():
                if name in fixed:
                    g[fixed[name]] = 0
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    # Calibrated on the held fifth; then from the sample's share of label 1 to the prior.
    model.p, model.slope, model.shift = best
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = np.clip(prior, 1e-3, 1 - 1e-3)
    model.shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def _calibration(z, y):
    """Log loss after calibration, slope and shift; without both labels slope 1."""
    import numpy as np

    slope, shift = _platt(z, y) if len(y) > 20 and 0 < y.mean() < 1 else (1.0, 0.0)
    return _softplus(np.where(y > 0.5, -1, 1) * (slope * z + shift)).sum(), slope, shift


def _platt(z, y):
    """Slope and shift of a logistic curve, by Newton's method with a weak prior on slope 1."""
    import numpy as np

    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (p - y) + 0.5 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
    return float(max(w[0], 0.05)), float(w[1])


def _all_logits(model: Recurrent, distinct: list[bytes], index, mask):
    import numpy as np

    gates = model.gates(model.inputs(encode_words(distinct)))
    return np.concatenate([model.run(gates, index[k : k + CHUNK], mask[k : k + CHUNK]) for k in range(0, len(index), CHUNK)])


def fit(
    docs: DataFrame, labels: DataFrame, learn_from, label: str = "toxic", toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, prior: float | None = 0.5
) -> Recurrent:
    """Train on at most toxic + clean labelled documents.

    Scores are calibrated for this prior share of label 1; at 0.5 a score says which label the text speaks for, whatever
    the labels' shares. None: the share among all labels.
    """
    known = labels.where(F.col(label).isNotNull()).where(learn_from)
    if prior is None:
        prior = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    some = [labelled_sample(docs, known.where(F.col(label) == v), label, F.lit(True), n) for v, n in ((1, toxic), (0, clean))]
    got = some[0].select("text", "y").unionAll(some[1].select("text", "y")).orderBy("y", "text").toPandas()
    return train(got["text"].tolist(), got["y"].to_numpy(), prior if prior is not None else 0.5)


def _scores(model: Recurrent, size: int = 128):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                some = batch.slice(k, size)
                score = scorer.score(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels count only where crc32(doc_id as text) mod 5 is not 0; of a document labelled twice the higher label
    counts, and ties in the sample's order go by id. Null, empty and wordless texts are one window without
    words and get the score of nothing read; of very long texts all windows are scored. Rows with null ids
    are never held out (false); repeated rows are scored each; an empty table gives no rows.
    Other columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = docs.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
