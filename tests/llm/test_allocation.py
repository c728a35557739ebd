import collections
import random

import numpy as np
import pytest

from faultline.llm import setjoin

from .test_text_operators import documents, linked

NUM, DEN = 85, 100


def both(a, b):
    values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    bands = setjoin.Bands(NUM, DEN)
    sig, owner, part = setjoin.signatures(values, bounds, bands)
    return bands, values, bounds, sig, owner, part


def agree(sig, owner, keep):
    return set(sig[(owner == 0) & keep].tolist()) & set(sig[(owner == 1) & keep].tolist())


def crowded(rng, size, segment, of):
    """Hashes that all fall into one of ``of`` segments."""
    high = (rng.integers(0, (1 << 32) // of - 1, size, dtype=np.uint64) + np.uint64(((1 << 32) * segment) // of + 1)) << np.uint64(32)
    return np.unique(high + rng.integers(0, 1 << 32, size, dtype=np.uint64))


@pytest.mark.parametrize("size", [7, 8, 10])
def test_short_sets_need_their_deletions(size):
    """All elements in one segment and one of them missing: no subset agrees, a deletion does."""
    rng, bands = np.random.default_rng(size), setjoin.Bands(NUM, DEN)
    for _ in range(30):
        j = int(bands.of(np.array([size - 1]))[0])
        bands.of(np.array([4 * size]))
        b = crowded(rng, size, int(rng.integers(bands.segments[j])), bands.segments[j])
        a = np.delete(b, rng.integers(len(b)))
        if DEN * len(a) < NUM * len(b):
            continue
        _, _, _, sig, owner, part = both(a, b)
        assert agree(sig, owner, np.ones(len(sig), bool))
        assert setjoin.Segments(a, np.array([0, len(a)]), bands, 0).short[0]
        if bands.of(np.array([len(a)]))[0] == bands.of(np.array([len(b)]))[0]:
            assert not agree(sig, owner, part == 0)


def test_bare_sets_need_their_empty_segments():
    """Elements in one segment, more of them replaced than deletions allow: only empty segments agree."""
    rng, bands = np.random.default_rng(5), setjoin.Bands(NUM, DEN)
    size = 26
    j = int(bands.of(np.array([size]))[0])
    assert bands.most[j] >= 4
    for _ in range(20):
        a = crowded(rng, size, 0, bands.segments[j] * 4)
        b = np.unique(np.concatenate([a[:-2], crowded(rng, 2, 0, bands.segments[j] * 4)]))
        _, _, _, sig, owner, part = both(a, b)
        assert len(a) == len(b) == size
        assert agree(sig, owner, (part >> 1) < 0) and not agree(sig, owner, (part >> 1) >= 0)


def test_credits_suffice_whatever_is_left_out():
    """Every set keeps more credits than its band's largest difference after its costliest choices are dropped."""
    rng, bands = np.random.default_rng(1), setjoin.Bands(NUM, DEN)
    for size in (1, 5, 7, 12, 20, 60, 300):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        bounds = np.array([0, len(a)])
        for below in (0, 1):
            s = setjoin.Segments(a, bounds, bands, below)
            if not s.m[0]:
                continue
            subsets, more = (int(x[0]) for x in s.spare())
            options = int(s.twos[0]) * int(s.short[0]) + (int(s.m[0] - s.filled[0]) if s.bare[0] else 0)
            assert subsets >= 0 and more >= 0
            assert int(s.filled[0]) - subsets + options - more == int(s.h[0]) + 1


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Many documents share most of their lines; blocks and frequent signatures are cut small."""
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    rng = random.Random(7)
    line = [" ".join(f"l{k}w{i}" for i in range(40)) for k in range(3)]
    rows = [(i, " ".join([*line, *(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([2, 4, 8, 30])))])) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(100)]
    got = collections.Counter(tuple(r) for r in setjoin.jaccard_components(documents(spark, rows), 4, NUM, DEN).collect())
    assert got == linked(rows, 4, NUM, DEN)
