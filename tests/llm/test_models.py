"""The classifiers against plain loops, and what only pairs of terms can tell."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import quality, toxicity


def packed(texts):
    return toxicity.packed_terms(pa.array(texts, pa.string()))


def paired(rng, n, label):
    texts, labels = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{i}x" for i in rng.integers(0, 400, 30)] + ["gruppe"] * a + ["bosheit"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(label(a, b)))
    return texts, np.array(labels)


def scores(model, texts):
    return model.score_texts(pa.array(texts, pa.string()))


def linear(model):
    return toxicity.FactorizationMachine(model.slots, model.bias, model.weights, model.factors * 0)


@pytest.mark.parametrize("label,alone", [(lambda a, b: a == b, 0.72), (lambda a, b: a and b, 0.85)])
def test_interactions_are_learnt(label, alone):
    """Both terms or neither: each alone says nothing, so neither a one-term screen nor weights could do it."""
    rng = np.random.default_rng(0)
    texts, labels = paired(rng, 3000, label)
    model = toxicity.fit(labels, packed(texts))
    texts, labels = paired(rng, 1000, label)
    assert ((scores(model, texts) > 0.5) == labels).mean() > 0.97
    assert ((scores(linear(model), texts) > 0.5) == labels).mean() < alone


def test_neutral_terms_of_a_telling_pair_are_inputs():
    rng = np.random.default_rng(3)
    texts, labels = paired(rng, 3000, lambda a, b: a == b)
    p = packed(texts)
    owner, bucket = np.repeat(np.arange(len(p)), [len(x) // 4 for x in p]), np.frombuffer(b"".join(p), np.int32)
    wanted = {int(np.frombuffer(packed([w])[0], np.int32)[0]) for w in ("gruppe", "bosheit")}
    assert wanted <= set(toxicity.telling_pairs(labels.astype(float), owner, bucket, 4096, 256).tolist())
    noise = rng.permutation(labels).astype(float)
    assert not len(toxicity.telling_pairs(noise, owner, bucket, 4096, 256))


def test_scores_equal_a_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    texts, labels = paired(rng, 400, lambda a, b: a == b)
    model = toxicity.fit(labels, packed(texts))
    texts = [*texts[:40], "", None, "gruppe", "GRUPPE bosheit " * 500]
    for text, got in zip(texts, scores(model, texts)):
        inputs = sorted({int(model.slots[b]) for b in np.frombuffer(packed([text])[0], np.int32)} - {-1})
        z = model.bias + sum(model.weights[i] for i in inputs)
        for i in inputs:
            for j in inputs:
                if i < j:
                    z += float(model.factors[i] @ model.factors[j])
        assert got == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-9)


RUN = re.compile(rb"[\x80-\xff0-9A-Za-z]+|[^\x80-\xff0-9A-Za-z\x20\x09-\x0d]+")
SOME = ["a b a, c!! d", "é ü a b", "", None, "x", "... a b c " * 30, "1 2 3"]


def rows_of(text):
    """Row of each token, through the vectoriser one token at a time."""
    return [int(quality.token_rows(pa.array([t.decode()]))[0][0]) for t in RUN.findall((text or "").encode())]


def test_contexts_and_pools_equal_a_loop():
    dims, signs = quality.index_vectors()
    want = np.zeros((quality.VOCABULARY, quality.DIMS), dtype=np.int64)
    for text in SOME:
        rows = rows_of(text)
        for i in range(len(rows) - 1):
            for here, there in ((rows[i], rows[i + 1]), (rows[i + 1], rows[i])):
                for k in range(2):
                    want[here, dims[there, k]] += signs[there, k]
    assert (quality.context_sums(pa.array(SOME), dims, signs) == want).all()

    vectors = np.random.default_rng(6).normal(size=(quality.VOCABULARY, quality.DIMS)).astype(np.float32)
    got = quality.pooled(pa.array(SOME), vectors)
    for text, row in zip(SOME, got):
        v = np.array([vectors[r] for r in rows_of(text)], dtype=np.float64).reshape(-1, quality.DIMS)
        n = len(v)
        mean, spread = (v.mean(0), v.std(0)) if n else (np.zeros(quality.DIMS),) * 2
        near = sum(v[i] * v[i + 1] for i in range(n - 1)) / max(1, n - 1) if n else np.zeros(quality.DIMS)
        assert np.allclose(row, [*mean, *spread, *(near + np.zeros(quality.DIMS)), math.log1p(n)], atol=2e-3)


def test_network_equals_a_loop():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 2, 200)
    net = quality.fit(y, x.astype(np.float32), hidden=4, steps=20)
    w1, b1, w2, b2 = net.layers
    for row, got in zip(x[:20].astype(np.float32), net.score(x[:20].astype(np.float32))):
        z = [(float(row[i]) - net.shift[i]) / net.scale[i] for i in range(5)]
        h = [max(0.0, sum(z[i] * w1[i, j] for i in range(5)) + b1[j]) for j in range(4)]
        logit = (sum(h[j] * w2[j] for j in range(4)) + b2[0]) / net.temperature
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
