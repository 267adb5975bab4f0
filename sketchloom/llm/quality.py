"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse random index vector, drawn from its hash; words of the
training sample also have a context vector, the sum of the index vectors that
stood beside them.  A document pools its words' vectors.  Words are taken with
their case and punctuation, and each gives two terms, itself and its shape
(kinds of its characters, its ends, its length), so that the open vocabulary of
unseen words still gets vectors.  A
numpy network with one hidden layer reads the pooled vector, and a temperature
fitted on documents apart makes its outputs probabilities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fit_bounded, labelled_sample, text_of
from .textblocks import Words, blocks, mix, word_arrays

BUCKETS, DIM, NONZERO = 1 << 15, 24, 4
HIDDEN = 24
MAX_ROWS, MAX_BYTES = 6000, 64_000_000
_SHAPE = np.zeros(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = 1
_SHAPE[ord("a") : ord("z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[0x80:] = 2
_SHAPE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4


def index_vectors() -> np.ndarray:
    """A ternary vector for each bucket, NONZERO components of it not 0."""
    at = np.arange(BUCKETS * NONZERO, dtype=np.uint64)
    h = mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99))
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    sign = np.where(h & np.uint64(1), 1.0, -1.0).astype(np.float32)
    np.add.at(out, ((at // NONZERO).astype(np.int64), ((h >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64)), sign)
    return out


def word_terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word of a block, and of its shape: counts of kinds of bytes, ends, length."""
    kind = _SHAPE[w.bytes]
    counts = []
    for k in (1, 3, 4):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        counts.append(np.minimum(sums[w.end] - sums[w.start], 3))
    last = w.bytes[w.end - 1].astype(np.uint64)
    last = np.where(kind[w.end - 1] == 4, last, kind[w.end - 1])
    length = np.minimum(w.end - w.start, 15)
    shape = ((counts[0] * 4 + counts[1]) * 4 + counts[2]).astype(np.uint64)
    shape = (shape * np.uint64(8) + kind[w.start]) * np.uint64(256) + last
    shape = shape * np.uint64(2) + (length > 12)
    limit = np.uint64(BUCKETS // 2)
    return (w.hash % limit).astype(np.int64), (mix(shape + np.uint64(7)) % limit + limit).astype(np.int64)


def pooled(texts: list[str], vectors: np.ndarray) -> Iterator[np.ndarray]:
    """Mean vector of a text's words, mean of its shapes, and statistics of both."""
    for block in blocks(t.encode("utf-8", "surrogatepass") for t in texts):
        (word, shape), first, last = word_arrays(block, word_terms)
        for a, b in zip(first.tolist(), last.tolist()):
            n = b - a
            if not n:
                yield np.zeros(2 * DIM + 8, dtype=np.float32)
                continue
            by_word = np.bincount(word[a:b], minlength=1)
            used = np.flatnonzero(by_word)
            share = by_word[used] / n
            by_shape = np.bincount(shape[a:b] - BUCKETS // 2)
            forms = np.flatnonzero(by_shape)
            form_share = by_shape[forms] / n
            m, s = share @ vectors[used], form_share @ vectors[forms + BUCKETS // 2]
            twice = float((word[a + 1 : b] == word[a : b - 1]).mean()) if n > 1 else 0.0
            again = float((word[a + 2 : b] == word[a : b - 2]).mean()) if n > 2 else 0.0
            more = [np.log1p(n) / 5, len(used) / n, float((share**2).sum()) * 5, float(share.max()), twice, again, float((form_share**2).sum()), 1.0]
            yield np.concatenate([m, s, more]).astype(np.float32)


def context_vectors(texts: list[str], index: np.ndarray) -> np.ndarray:
    """Index vectors, plus for words of the sample the normalised sum of their neighbours'."""
    context = np.zeros_like(index)
    for block in blocks(t.encode("utf-8", "surrogatepass") for t in texts):
        (word, shape), first, _ = word_arrays(block, word_terms)
        inside = np.ones(len(word), dtype=bool)
        inside[first[first < len(word)]] = False  # no neighbour before a text's first word
        here = np.flatnonzero(inside)
        for term in (word, shape):
            for beside in (word, shape):
                np.add.at(context, term[here], index[beside[here - 1]])
                np.add.at(context, term[here - 1], index[beside[here]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + context / np.maximum(norm, 1e-6)


@dataclass(frozen=True)
class Model:
    """Word vectors and the network; ``layers`` is empty if there was nothing to learn."""

    vectors: np.ndarray
    layers: tuple
    temperature: float
    prior: float


def _forward(layers, x):
    mean, scale, w1, b1, w2, b2 = layers
    h = np.maximum((x - mean) / scale @ w1 + b1, 0)
    return h, (h @ w2 + b2)[:, 0]


def _train_network(x, y, epochs: int = 60, seed: int = 3):
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    params = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            h = np.maximum(z[rows] @ params[0] + params[1], 0)
            d = (1 / (1 + np.exp(-np.clip((h @ params[2] + params[3])[:, 0], -30, 30))) - y[rows])[:, None] / len(rows)
            dh = (d @ params[2].T) * (h > 0)
            grads = [z[rows].T @ dh + 1e-3 * params[0], dh.sum(axis=0), h.T @ d + 1e-3 * params[2], d.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return (mean, scale, *params)


def _temperature(logit, y) -> float:
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [float(np.mean(np.logaddexp(0, logit / t) - y * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(texts: list[str], ys: list[float]) -> Model:
    """Vectors and network from four fifths of the texts, temperature from the rest."""
    prior = float(np.mean(ys)) if ys else 0.5
    index = index_vectors()
    y = np.array(ys)
    # by the text, so that exact copies fall on the same side
    apart = np.array([int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 5 == 0 for t in texts], dtype=bool)
    if len(set(y[~apart].tolist())) < 2:
        return Model(index, (), 1.0, prior)
    vectors = context_vectors([t for t, a in zip(texts, apart) if not a], index)
    x = np.stack(list(pooled(texts, vectors))).astype(np.float64)
    layers = _train_network(x[~apart], y[~apart])
    heat = _temperature(_forward(layers, x[apart])[1], y[apart]) if apart.any() else 1.0
    return Model(vectors, tuple(np.asarray(p, dtype=np.float64) for p in layers), heat, prior)


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    if not model.layers or not texts:
        return np.full(len(texts), model.prior)
    x = np.stack(list(pooled(texts, model.vectors))).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(_forward(model.layers, x)[1] / model.temperature, -30, 30)))


def _fit(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int):
    model = fit_bounded(labelled_sample(docs, labels, "quality", max_rows), max_bytes, train)
    return docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes at any size of input


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Return (doc_id, score), one row per document, the whole text being scored.

    The model is fitted on at most ``max_rows`` labelled documents and
    ``max_bytes`` of text outside the held-out fold.  A null or empty text pools
    to the zero vector, which the network scores like any other.  Without labels
    of both kinds every score is the share of good labels (0.5 if there are
    none).  Rows that repeat give repeated rows; a null doc_id stays null; other
    columns are ignored.
    """
    shared = _fit(docs, labels, max_rows, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = probabilities(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, least: float, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, in the same columns and without a shuffle."""
    shared, at = _fit(docs, labels, max_rows, max_bytes), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(shared.value, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
