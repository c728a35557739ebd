"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits and their first few bytes, hashed into ``BUCKETS``.
The model's inputs (present or absent in a document) are the ``TERMS`` terms that differ most between
labels, and the terms of the ``PAIRS`` pairs that interact most: of the ``FREQUENT`` most frequent terms
every pair is screened for a share of label 1 that its two terms do not explain one by one. So terms
that tell nothing alone, such as a group's name, become inputs if they tell something together. Beside
a weight, every input has a vector; the products of vectors score pairs, which weights alone would miss.

The fit uses at most ``sample.SAMPLE_DOCS`` labelled documents; scoring covers every whole text.

Defined results: null, empty and term-free texts get the model's score of no term; with no label 1
(or no label 0) to learn from, every score is 0 (or 1); a document with a null id is in the fold of
the empty text; repeated rows and ids are scored each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import SAMPLE_DOCS, adam, fold, labelled_features, sigmoid
from .storage import tidied, tidy
from .text import Words, chunks, string_column

BUCKETS = 1 << 18
#: Bounds of the model: inputs chosen one by one, pairs chosen together, terms screened for pairs.
TERMS = 1024
PAIRS = 256
FREQUENT = 4096
FACTORS = 8
#: Besides the whole term, its first bytes are terms too: families of words share a beginning.
PREFIXES = (4, 5)
THRESHOLD = 0.7


def term_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each term of a chunk, and the document it is in."""
    w = Words(texts, lower=True, kind="letters")
    salted = [w.hashes()] + [w.hashes(prefix=p) * np.uint64(2 * p + 1) for p in PREFIXES]
    doc = w.doc_of_word()
    return (np.concatenate(salted) >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate([doc] * len(salted))


def packed_terms(texts: pa.Array) -> list[bytes]:
    out: list[bytes] = []
    for lo, hi in chunks(texts):
        bucket, doc = term_buckets(texts.slice(lo, hi - lo))
        pairs = np.unique(doc.astype(np.int64) * BUCKETS + bucket)
        bounds = np.searchsorted(pairs, np.arange(hi - lo + 1) * BUCKETS)
        terms = (pairs & (BUCKETS - 1)).astype(np.int32)
        out += [terms[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


@dataclass
class FactorizationMachine:
    slots: np.ndarray  # bucket -> input, -1 where it is none
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` documents from their distinct inputs."""
        z = self.bias + np.bincount(doc, self.weights[slot], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f]
            z += 0.5 * (np.bincount(doc, v, minlength=n) ** 2 - np.bincount(doc, v * v, minlength=n))
        return sigmoid(z)

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        bucket, doc = term_buckets(texts)
        slot = self.slots[bucket]
        known = slot >= 0
        pairs = np.unique(doc[known].astype(np.int64) * len(self.weights) + slot[known])
        return self.score(pairs // len(self.weights), pairs % len(self.weights), len(texts))


def telling_terms(y: np.ndarray, owner: np.ndarray, bucket: np.ndarray, terms: int) -> np.ndarray:
    """Terms of two documents or more whose frequency differs between labels, those that differ most first."""
    n1, n0 = y.sum(), len(y) - y.sum()
    with1 = np.bincount(bucket, y[owner], minlength=BUCKETS)
    with0 = np.bincount(bucket, minlength=BUCKETS) - with1
    share = (with1 + with0) / len(y)
    spread = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-9
    value = np.where(with1 + with0 >= 2, np.abs(with1 / n1 - with0 / n0) / spread, 0)
    best = np.argsort(-value, kind="stable")[:terms]
    return best[value[best] > 2.5]


def telling_pairs(y: np.ndarray, owner: np.ndarray, bucket: np.ndarray, frequent: int, pairs: int, least: float = 8.0, support: float = 0.01) -> np.ndarray:
    """Terms of the pairs that interact most: the share of label 1 where both, one or none occurs is not additive.

    The contrast of the four shares is set against its standard error; ``least`` errors are needed, and a
    share ``support`` of the documents, eight at least, with both terms: what a group of copies shares by
    chance tells nothing.
    """
    support = max(8, support * len(y))
    overall = np.float32(y.mean() * (1 - y.mean()))
    seen = np.bincount(bucket, minlength=BUCKETS)
    chosen = np.argsort(-seen, kind="stable")[: min(frequent, 1 << 15)]
    chosen = chosen[seen[chosen] >= support]
    if len(chosen) < 2:
        return np.empty(0, dtype=np.int64)
    row = np.full(BUCKETS, -1, dtype=np.int16)
    row[chosen] = np.arange(len(chosen))
    at = row[bucket]
    bits, marginal = [], []
    for label in (1, 0):
        docs = np.flatnonzero(y == label)
        place = np.full(len(y), -1, dtype=np.int32)
        place[docs] = np.arange(len(docs))
        here = (at >= 0) & (place[owner] >= 0)
        present = np.zeros((len(chosen), -(-len(docs) // 64) * 64), dtype=bool)
        present[at[here], place[owner[here]]] = True
        bits.append(np.packbits(present, axis=1).view(np.uint64))
        marginal.append(present.sum(axis=1).astype(np.float32))
    total = [np.float32((y == label).sum()) for label in (1, 0)]
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(chosen) - 1, 8):
        i = np.arange(lo, min(lo + 8, len(chosen)))
        both = [np.bitwise_count(b[i, None] & b[None, lo:]).sum(axis=2, dtype=np.int32).astype(np.float32) for b in bits]
        contrast = spread = np.float32(0)
        for sign, cell in ((1, lambda k: both[k]), (-1, lambda k: marginal[k][i, None] - both[k]), (-1, lambda k: marginal[k][None, lo:] - both[k]), (1, lambda k: total[k] - marginal[k][i, None] - marginal[k][None, lo:] + both[k])):
            ones, n = cell(0), cell(0) + cell(1)
            share = (ones + np.float32(0.5)) / (n + 1)
            contrast = contrast + sign * share
            spread = spread + np.maximum(overall, share * (1 - share)) / (n + 1)
        value = np.abs(contrast) / np.sqrt(spread)
        value[(both[0] + both[1] < support) | (np.arange(lo, len(chosen))[None] <= i[:, None])] = 0
        a, b = np.nonzero(value >= least)
        if len(a):
            found.append((value[a, b], i[a], lo + b))
    if not found:
        return np.empty(0, dtype=np.int64)
    value, a, b = (np.concatenate(x) for x in zip(*found))
    best = np.lexsort((b, a, -value))[:pairs]
    return np.unique(chosen[np.concatenate([a[best], b[best]])])


def fit(labels: np.ndarray, packed: list[bytes], terms: int = TERMS, factors: int = FACTORS, steps: int = 300, seed: int = 7, frequent: int = FREQUENT, pairs: int = PAIRS) -> FactorizationMachine:
    y = labels.astype(np.float64)
    slots = np.full(BUCKETS, -1, dtype=np.int32)
    if not len(y) or y.min() == y.max():
        constant = 60.0 if len(y) and y.min() == 1 else -60.0
        return FactorizationMachine(slots, constant, np.zeros(1), np.zeros((1, factors)))
    owner = np.repeat(np.arange(len(y), dtype=np.int32), [len(p) // 4 for p in packed])
    bucket = np.frombuffer(b"".join(packed), dtype=np.int32)
    n1, n0 = y.sum(), len(y) - y.sum()
    best = np.union1d(telling_terms(y, owner, bucket, terms), telling_pairs(y, owner, bucket, frequent, pairs))
    if not len(best):
        return FactorizationMachine(slots, float(np.log(n1 / n0)), np.zeros(1), np.zeros((1, factors)))
    slots[best] = np.arange(len(best))
    x = np.zeros((len(y), len(best)), dtype=np.float32)
    slot = slots[bucket]
    x[owner[slot >= 0], slot[slot >= 0]] = 1
    weight = (np.where(y == 1, 0.5 / n1, 0.5 / n0) * 0.5 + 0.5 / len(y)).astype(np.float32)
    y = y.astype(np.float32)

    def gradient(params: list[np.ndarray]) -> list[np.ndarray]:
        b, w, v = (p.astype(np.float32) for p in params)
        xv = x @ v
        z = b[0] + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v * v).sum(1))
        e = (sigmoid(z) - y) * weight
        gv = x.T @ (e[:, None] * xv) - (x.T @ e)[:, None] * v
        return [np.array([e.sum()]), x.T @ e + np.float32(2e-6) * w, gv + np.float32(1e-4) * v]

    start = [np.array([np.log(n1 / n0)]), np.zeros(len(best)), np.random.default_rng(seed).normal(0, 0.02, (len(best), factors))]
    b, w, v = adam(start, gradient, steps, 0.05)
    return FactorizationMachine(slots, float(b[0]), w, v)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = SAMPLE_DOCS) -> FactorizationMachine:
    model = fit(*labelled_features(docs, labels, "toxic", F.lit(True) if usable is None else usable, packed_terms, limit))
    tidy()
    return model


SCORES = "doc_id long, score double"


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id, score`` of every document."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "text")
            parts = [model.score_texts(texts.slice(lo, hi - lo)) for lo, hi in chunks(texts)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``; the held-out fold's labels are never learnt from."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != held)
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def non_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; fitted on all labels."""
    model = train(docs, labels)
    schema = docs.schema

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "text")
            parts = [model.score_texts(texts.slice(lo, hi - lo)) for lo, hi in chunks(texts)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) < threshold))

    return docs.mapInArrow(run, schema)
