import collections
import random

import pytest

from faultline.llm import substring

TEXTS = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(9000)}" for _ in range(n)]


def parsed(rows, size):
    """Greedy factors by brute force: from each start the longest match with any other place."""
    docs = [(d, (t or "").split()) for d, t in rows]
    places = collections.defaultdict(list)
    for k, (_, w) in enumerate(docs):
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].append((k, i))
    out = {}
    for k, (d, w) in enumerate(docs):
        factors, i = [], 0
        while i <= len(w) - size:
            best = 0
            for j, at in places[tuple(w[i : i + size])]:
                if (j, at) != (k, i):
                    v, n = docs[j][1], size
                    while i + n < len(w) and at + n < len(v) and w[i + n] == v[at + n]:
                        n += 1
                    best = max(best, n)
            if best:
                factors.append((i, best))
                i += best - size + 1  # the first window across the boundary
            else:
                i += 1
        out[d] = factors
    return out


def check(spark, rows, size=35):
    want = parsed(rows, size)
    spans = substring.duplicate_spans(spark.createDataFrame(rows, TEXTS), size).collect()
    got = {d: sorted((r.start, r.n_words) for r in spans if r.doc_id == d) for d, _ in rows}
    assert got == want
    text = {d: (t or "").split() for d, t in rows}
    for r in spans:
        own = text[r.doc_id][r.start : r.start + r.n_words]
        assert own == text[r.ref_key][r.ref_start : r.ref_start + r.n_words] and " ".join(own) == r.span
        assert (r.doc_id, r.start) != (r.ref_key, r.ref_start)
    counts = {r.doc_id: r.n_factors for r in substring.substring_dedup(spark.createDataFrame(rows, TEXTS), size).collect()}
    assert counts == {d: len(f) for d, f in want.items()}
    return want


def test_a_copy_is_one_factor_whatever_came_before(spark):
    rng = random.Random(1)
    a = words(rng, 200)
    rows = [(1, " ".join(a[60:110])), (2, " ".join(a)), (3, " ".join(a)), (4, " ".join(words(rng, 30) + a[20:90] + words(rng, 9) + a[100:180]))]
    assert [len(f) for f in check(spark, rows).values()] == [1, 1, 1, 2]


def test_chained_passages_break_at_their_boundaries(spark):
    rng = random.Random(2)
    a, b, c = words(rng, 80), words(rng, 70), words(rng, 60)
    rows = [(1, " ".join(words(rng, 5) + a)), (2, " ".join(b + words(rng, 4))), (3, " ".join(a + b)), (4, " ".join(b + c)), (5, " ".join(words(rng, 3) + a + b + c)), (6, " ".join(c)), (7, None), (8, "")]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_break_at_their_edits(spark, seed):
    rng = random.Random(10 + seed)
    rows = []
    for g in range(6):
        base = words(rng, rng.choice([40, 120, 400]))
        for _ in range(rng.choice([2, 3])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(w)))
    check(spark, rows)


def test_repetition_within_a_document(spark):
    check(spark, [(1, "a " * 150), (2, "x y z " * 40), (3, "q " * 20 + "r"), (4, "u " * 3000)])


def test_frequent_contents_are_dealt_out(spark, monkeypatch):
    """A passage of every document, and as many copies of a document, below and above the count of a task."""
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 20) + passage + words(rng, 20))) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(70)]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(spark.createDataFrame(rows, TEXTS).repartition(2)).collect()}
    assert got == {(d, 100, 100 if d == 0 or d >= 100 else 60) for d, _ in rows}
