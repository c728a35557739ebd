"""Quality by random-indexing word vectors and a two-layer network.

Tokens are runs of letters and digits and runs of marks, hashed into ``VOCABULARY`` rows. Every row
has a fixed sparse random index vector; a row's context vector sums the index vectors of the tokens
beside it, over all documents. A token's vector is its normed context plus its index vector. A
document is pooled to the mean and spread of its tokens' vectors and the mean of the products of
neighbours; a network of two layers in numpy scores that, and a temperature fitted on a part of the
sample kept from training calibrates the probabilities.

Counts cover every document; the fit uses at most ``sample.SAMPLE_DOCS`` labelled ones. What reaches
the driver is the vocabulary-by-dimension table (fixed size) and the sample's pooled features.

Defined results: null, empty and token-free texts pool to zeros and get the network's score of that;
with no label 1 (or no label 0) every score is 0 (or 1); a null id is in the fold of the empty text;
repeated rows and ids are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import SAMPLE_DOCS, adam, fold, labelled_features, sigmoid
from .storage import tidied, tidy
from .text import Words, chunks, string_column

VOCABULARY = 1 << 14
DIMS = 32
HIDDEN = 24
THRESHOLD = 0.3
CHUNK_BYTES = 1_000_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two dimensions and their signs for each row."""
    rng = np.random.default_rng(11)
    dims = np.argsort(rng.random((VOCABULARY, DIMS)), axis=1)[:, :2]
    return dims.astype(np.int64), rng.choice(np.array([-1, 1]), (VOCABULARY, 2))


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts, kind="runs")
    return (w.hashes() & np.uint64(VOCABULARY - 1)).astype(np.int64), w.first


def context_sums(texts: pa.Array, dims: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of neighbours' index vectors by row, over a chunk of documents."""
    rows, first = token_rows(texts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = np.flatnonzero(doc[1:] == doc[:-1])
    out = np.zeros(VOCABULARY * DIMS, dtype=np.int64)
    for here, there in ((near, near + 1), (near + 1, near)):
        for k in range(2):
            cell = rows[here] * DIMS + dims[rows[there], k]
            up = signs[rows[there], k] > 0
            out += np.bincount(cell[up], minlength=len(out))
            out -= np.bincount(cell[~up], minlength=len(out))
    return out.reshape(VOCABULARY, DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Token vectors from the contexts of all documents, one row a vocabulary entry."""
    dims, signs = index_vectors()
    columns = ", ".join(f"c{i} long" for i in range(DIMS))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOCABULARY, DIMS), dtype=np.int64)
        for batch in batches:
            texts = string_column(batch, "text")
            for lo, hi in chunks(texts, CHUNK_BYTES):
                total += context_sums(texts.slice(lo, hi - lo), dims, signs)
        row = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(row), *[pa.array(np.ascontiguousarray(total[row, i])) for i in range(DIMS)]], names=["row", *[f"c{i}" for i in range(DIMS)]])

    sums = docs.select("text").mapInArrow(run, f"row long, {columns}").groupBy("row").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(DIMS)]).toArrow()
    context = np.zeros((VOCABULARY, DIMS))
    context[sums.column("row").to_numpy()] = np.stack([sums.column(f"c{i}").to_numpy() for i in range(DIMS)], axis=1) if sums.num_rows else 0
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    own = np.zeros((VOCABULARY, DIMS))
    for k in range(2):
        own[np.arange(VOCABULARY), dims[:, k]] += signs[:, k]
    return (np.divide(context, norm, out=np.zeros_like(context), where=norm > 0) + own / np.sqrt(2)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and neighbour products of each document's token vectors, and its log length."""
    rows, first = token_rows(texts)
    n = len(first) - 1
    count = np.diff(first).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, 3 * DIMS + 1), dtype=np.float32)
    has = count > 0
    if len(rows):
        near = (doc[1:] == doc[:-1]).astype(np.float32)
        at = first[:-1][has]
        for d in range(DIMS):
            v = vectors[rows, d]
            mean = np.add.reduceat(v, at) / count[has]
            out[has, d] = mean
            out[has, DIMS + d] = np.sqrt(np.maximum(0, np.add.reduceat(v * v, at) / count[has] - mean * mean))
            product = np.append(v[1:] * v[:-1] * near, np.float32(0))
            out[has, 2 * DIMS + d] = np.add.reduceat(product, at) / np.maximum(1, count[has] - 1)
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # w1, b1, w2, b2
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(0, ((x - self.shift) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.logits(x.astype(np.float64)) / self.temperature)


def fit(labels: np.ndarray, x: np.ndarray, hidden: int = HIDDEN, steps: int = 300, seed: int = 5) -> Network:
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(1), np.ones(1), [], 1.0, float(len(y) and y.min()))
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    kept = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
    if y[~kept].min() == y[~kept].max():
        kept[:] = False
    shift, scale = x[~kept].mean(0), x[~kept].std(0) + 1e-3
    net = Network(shift, scale, [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)], 1.0)
    z, t = (x[~kept] - shift) / scale, y[~kept]

    def gradient(params: list[np.ndarray]) -> list[np.ndarray]:
        w1, b1, w2, b2 = params
        h = np.maximum(0, z @ w1 + b1)
        e = (sigmoid(h @ w2 + b2) - t) / len(t)
        back = np.outer(e, w2) * (h > 0)
        return [z.T @ back + 1e-4 * w1, back.sum(0), h.T @ e + 1e-4 * w2, np.array([e.sum()])]

    net.layers = adam(net.layers, gradient, steps, 0.01)
    if kept.any():
        logit, target = net.logits(x[kept]), y[kept]
        grid = np.geomspace(0.25, 8, 60)
        loss = [-(np.log(np.where(target == 1, sigmoid(logit / g), sigmoid(-logit / g)) + 1e-12)).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


SCORES = "doc_id long, score double"


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; the held-out fold's labels are never learnt from."""
    vectors = word_vectors(docs)

    def features(texts: pa.Array) -> list[bytes]:
        return [r.tobytes() for lo, hi in chunks(texts, CHUNK_BYTES) for r in pooled(texts.slice(lo, hi - lo), vectors)]

    y, packed = labelled_features(docs, labels, "quality", fold(F.col("doc_id"), folds) != held, features, limit)
    net = fit(y, np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(y), 3 * DIMS + 1))
    tidy()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "text")
            parts = [net.score(pooled(texts.slice(lo, hi - lo), vectors)) for lo, hi in chunks(texts, CHUNK_BYTES)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
