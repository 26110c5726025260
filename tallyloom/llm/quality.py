"""Quality classifier (operator 4): random-indexing word vectors, pooled per document, a two-layer network.

Random indexing: every token and every token shape has a bucket and the bucket a sparse
ternary index vector drawn from a seed. A bucket's word vector is the sum of its neighbours'
index vectors over the whole corpus, scaled to length one. Documents are pooled to moments of
their word vectors; the network's probabilities are calibrated with a temperature.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import free_name

#: Buckets of tokens and of shapes, dimensions of a vector, non-zeros of an index vector.
LEXICAL, SHAPES, DIM, NONZERO = 8192, 1024, 48, 4
#: Bound on the labelled rows the network is fitted on; the smallest hashes of the id are taken.
FIT_ROWS = 20_000
#: Bounds a worker's memo of tokens: a full one starts over, so that it follows the texts and stays small while the worker waits.
MEMO = 150_000
#: Documents whose words are counted, and pooled, at a time: a word's vector is larger than its counts.
BATCH, POOLED = 256, 64
_RUN = re.compile(r"(.)\1+", re.S)
_SHAPE = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), "9")]


def _buckets(token: str) -> tuple[int, int]:
    shape = token
    for pattern, to in _SHAPE:
        shape = pattern.sub(to, shape)
    shape = _RUN.sub(r"\1", shape)
    lexical = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % LEXICAL
    return lexical, LEXICAL + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES


class _Memo(dict):
    """Token -> its two buckets in one number."""

    def __missing__(self, token: str) -> int:
        lexical, shape = _buckets(token)
        got = lexical * SHAPES + shape - LEXICAL
        if len(token) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[token] = got
        return got


_memo = _Memo()


def _tokens(texts: list[str | None]):
    """Lexical and shape buckets of all tokens of many documents, and the documents' sizes."""
    import numpy as np

    many = [(t or "").split() for t in texts]
    sizes = np.array([len(m) for m in many], np.int64)
    both = np.fromiter((_memo[t] for m in many for t in m), np.int32, int(sizes.sum()))
    return both // SHAPES, LEXICAL + both % SHAPES, sizes


@lru_cache(maxsize=1)
def _index():
    """Places and signs of the index vectors' non-zeros."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = LEXICAL + SHAPES
    return rng.integers(0, DIM, (n, NONZERO)), np.where(rng.random((n, NONZERO)) < 0.5, -1.0, 1.0)


def _contexts(batches: Iterator) -> Iterator:
    """One task's share of the word vectors: (bucket, d0, ...) rows."""
    import numpy as np
    import pyarrow as pa

    place, sign = _index()
    sums = np.zeros((LEXICAL + SHAPES) * DIM)
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            word, shape, sizes = _tokens(batch.column("text").slice(k, BATCH).to_pylist())
            if len(word) == 0:
                continue
            doc = np.repeat(np.arange(len(sizes)), sizes)
            near = doc[1:] == doc[:-1]
            left, right = word[:-1][near], word[1:][near]
            for of, by in ((left, right), (right, left), (shape, word), (word, shape)):
                flat = (of[:, None].astype(np.int64) * DIM + place[by]).ravel()
                sums += np.bincount(flat, sign[by].ravel(), len(sums))
    table = sums.reshape(-1, DIM)
    used = np.flatnonzero(np.abs(table).sum(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), *(pa.array(table[used, d]) for d in range(DIM))], names=["bucket", *(f"d{d}" for d in range(DIM))]
    )


def word_vectors(docs: DataFrame):
    """Random-indexing vectors from all documents, a (buckets x DIM) array of fixed size."""
    import numpy as np

    kind = "bucket int, " + ", ".join(f"d{d} double" for d in range(DIM))
    got = docs.select("text").mapInArrow(_contexts, kind).groupBy("bucket").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM))).toArrow()
    table = np.zeros((LEXICAL + SHAPES, DIM), np.float32)
    for d in range(DIM):
        table[got["bucket"].to_numpy(), d] = got[f"d{d}"].to_numpy()
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def _sums(rows, starts, sizes):
    """Sums of each document's rows; one sum a document is several times faster than reduceat over rows."""
    import numpy as np

    return np.stack([rows[a : a + n].sum(axis=0) for a, n in zip(starts.tolist(), sizes.tolist())])


def pooled(texts: list[str | None], vectors):
    """Moments of each document's word vectors: means of words and shapes, spread, likeness of neighbours."""
    import numpy as np

    word, shape, sizes = _tokens(texts)
    out = np.zeros((len(sizes), 3 * DIM + 4), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        n = sizes[some][:, None].astype(np.float32)
        v = vectors[word]
        mean = _sums(v, starts, sizes[some]) / n
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = _sums(vectors[shape], starts, sizes[some]) / n
        out[some, 2 * DIM : 3 * DIM] = np.sqrt(np.maximum(_sums(v * v, starts, sizes[some]) / n - mean**2, 0))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        like = np.zeros(len(word), np.float32)
        like[1:] = np.einsum("ij,ij->i", v[1:], v[:-1]) * (doc[1:] == doc[:-1])
        same = np.zeros(len(word), np.float32)
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        for k, x in enumerate((like, same)):
            out[some, 3 * DIM + k] = np.add.reduceat(x, starts) / n[:, 0]
        out[some, 3 * DIM + 2] = np.linalg.norm(mean, axis=1)
    out[:, 3 * DIM + 3] = np.log1p(sizes) / 5
    return out


class Network:
    """Two layers, tanh between, scaled inputs, and a temperature."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 7) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), 0.0
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def logits(self, x):
        import numpy as np

        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    def fit(self, x, y, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
        """Adam on four fifths of the rows; the last fifth sets the temperature."""
        import numpy as np

        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        cut = max(1, len(y) * 4 // 5)
        fit, held = order[:cut], order[cut:] if cut < len(y) else order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + np.float32(1e-3)
        z = (x - self.mean) / self.scale
        base = np.clip(y[fit].mean(), 0.01, 0.99)
        self.b2 = float(np.log(base / (1 - base)))
        m = [np.zeros_like(p) for p in (self.w1, self.b1, self.w2)] + [0.0]
        v = [np.zeros_like(p) for p in (self.w1, self.b1, self.w2)] + [0.0]
        t = 0
        for epoch in range(epochs):
            for k in range(0, len(fit), 128):
                rows = fit[rng.integers(0, len(fit), 128)] if len(fit) < 128 else fit[k : k + 128]
                h = np.tanh(z[rows] @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -60, 60)))
                g = (p - y[rows]) / len(rows)
                gh = g[:, None] * self.w2 * (1 - h * h)
                grads = [z[rows].T @ gh + decay * self.w1, gh.sum(axis=0), h.T @ g + decay * self.w2, g.sum()]
                t += 1
                step = rate * (1 - epoch / epochs)
                new = []
                for i, (q, gr) in enumerate(zip((self.w1, self.b1, self.w2, self.b2), grads)):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr * gr
                    new.append(q - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8))
                self.w1, self.b1, self.w2, self.b2 = new
            rng.shuffle(fit)
        logits, target = self.logits(x[held]), y[held]
        loss = lambda T: np.logaddexp(0, np.where(target > 0.5, -logits, logits) / T).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled documents: rows with a label, in order of a hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(where)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(known), "doc_id")  # bounded by `most` rows of two numbers


def _features(vectors):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, POOLED):
                some = batch.slice(k, POOLED)
                x = pooled(some.column("text").to_pylist(), vectors)
                yield pa.RecordBatch.from_arrays([some.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn_from, label: str = "quality", most: int = FIT_ROWS):
    """Word vectors from all documents and a network from a bounded labelled sample."""
    import numpy as np

    vectors = word_vectors(docs)
    sample = labelled_sample(docs, labels, label, learn_from, most)
    got = sample.mapInArrow(_features(vectors), "y double, x array<float>").toArrow().combine_chunks()
    y, network = got["y"].to_numpy(), Network(3 * DIM + 4)
    if len(np.unique(y)) > 1:
        x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        order = np.lexsort([*x.T[:3], y])  # the same order in every run
        network.fit(x[order], y[order])
    elif len(y):
        network.b2 = 4.0 if y[0] > 0.5 else -4.0
    return vectors, network


def _scores(vectors, network: Network):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, POOLED):
                some = batch.slice(k, POOLED)
                score = network.score(pooled(some.column("text").to_pylist(), vectors))
                rest = [c for c in some.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), pa.array(score.astype(float))], names=[*rest, "score"])

    return run


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels count only where crc32(doc_id as text) mod 3 is not 1; of a document labelled twice the higher
    label counts, and ties in the sample's order go by id. Null and empty texts pool to zeros and are
    scored like any text, very long ones whole; a null id is never held out (false). Repeated rows
    are scored each; an empty table gives no rows; without usable labels every score comes
    from an untrained network. Other columns are not read. At most FIT_ROWS labelled rows are learned from, those with the
    least hashes of their id.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    vectors, network = fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    scored = docs.mapInArrow(_scores(vectors, network), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, of the documents the classifier does not reject (score >= 0.5).

    Rows are judged one by one, so ids may be null, tie or repeat; null and empty texts are scored like any other, very long ones
    whole. An empty table stays empty, and clashing column names are kept as they are.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    vectors, network = fit(plain, labels, fold(F.col("doc_id"), 3) != 1)
    score = F.arrow_udf(lambda t: _score_array(t, vectors, network), "double")
    name = free_name(docs, "_score")
    return docs.withColumn(name, score(docs[text_col].cast("string"))).where(F.col(name) >= 0.5).drop(name)


def _score_array(texts, vectors, network: Network):
    import numpy as np
    import pyarrow as pa

    got = [network.score(pooled(texts.slice(k, POOLED).to_pylist(), vectors)) for k in range(0, len(texts), POOLED)]
    return pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())


