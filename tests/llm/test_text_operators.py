import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import decontam, mixing, quality, setjoin, substring, text, toxicity

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") if rows and len(rows[0]) == 5 else spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as score", "'x' as node", "2 as `at`", "3 as label") if extra else df


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [(3, "a b"), (3, "a b"), (4, "A B"), (5, None), (6, ""), (7, "x"), (8, " y "), (None, "x"), (9, "q " * 20000)]


def test_words_agree_with_the_pattern():
    texts = ["a b\tc\n\n d", "", "  ", "é ü x", "one", "\x0bx\x0c"]
    w = text.Words(pa.array(texts))
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in WORD.findall(t)]
    assert w.counts.tolist() == [len(WORD.findall(t)) for t in texts]
    h = text.Words(pa.array(["Foo foo FOO É é"]), lower=True).hashes()
    assert len(set(h[:3])) == 1 and h[3] != h[4]


# --- n-gram Jaccard join ----------------------------------------------------------------------

def linked(rows, n, num, den):
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, a) in enumerate(sets):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known) if known else None
    return collections.Counter((d, len(a), least[find(i)] if a else d) for i, (d, a) in enumerate(sets))


def near_copies(seed, groups=25):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        size = rng.choice([3, 5, 7, 8, 10, 12, 15, 20, 30, 60, 150])
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(rng.choice([2, 3, 6, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 40) + 1)):
                at, how = rng.randrange(len(w)), rng.randrange(3)
                if how == 0:
                    w[at] = f"w{rng.randrange(3000)}"
                elif how == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, f"w{rng.randrange(3000)}")
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_components_equal_brute_force(spark, n, num, den):
    rows = near_copies(n)
    got = collections.Counter(tuple(r) for r in setjoin.jaccard_components(documents(spark, rows), n, num, den).collect())
    assert got == linked(rows, n, num, den)


def test_jaccard_edge_cases(spark):
    got = collections.Counter(tuple(r) for r in setjoin.jaccard_components(documents(spark, EDGE, extra=True)).collect())
    assert got == linked(EDGE, 4, 85, 100)
    assert setjoin.jaccard_components(documents(spark, EDGE).limit(0)).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([a[:150], b[:40]]))
    s = setjoin.odd_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_one_of_each_keeps_the_least_id(spark):
    rows = [(1, prose(random.Random(1), 80)), (2, prose(random.Random(2), 80))]
    rows += [(5, rows[0][1]), (6, rows[0][1] + " more"), (7, None)]
    assert sorted(r.doc_id for r in setjoin.one_of_each(documents(spark, rows)).collect()) == [1, 2, 7]


# --- substrings -------------------------------------------------------------------------------

def windowed(rows, size):
    count, docs = collections.Counter(), []
    for d, t in rows:
        w = WORD.findall(t or "")
        docs.append((d, w))
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def test_substrings_equal_brute_force(spark):
    rng = random.Random(4)
    passages = [prose(rng, k, 5000) for k in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(1, 80), 5000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 30), 5000)]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a " * 90), (101, "1 2 " * 40), (102, None), (103, ""), (104, rows[0][1])]
    got = collections.Counter(tuple(r)[:4] for r in substring.substring_dedup(documents(spark, rows, extra=True)).collect())
    assert got == windowed(rows, 35)


def test_substring_edge_cases(spark):
    got = collections.Counter(tuple(r)[:4] for r in substring.substring_dedup(documents(spark, EDGE)).collect())
    assert got == windowed(EDGE, 35)
    assert substring.substring_dedup(documents(spark, EDGE).limit(0)).count() == 0


def test_spans_point_at_equal_words(spark):
    rng = random.Random(6)
    shared = prose(rng, 50, 9000)
    rows = [(1, prose(rng, 40, 9000) + " " + shared), (2, shared + " " + prose(rng, 40, 9000))]
    spans = substring.duplicate_spans(documents(spark, rows)).collect()
    words = {d: t.split() for d, t in rows}
    assert {r.doc_id for r in spans} == {1, 2}
    for r in spans:
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.ref_key][r.ref_start : r.ref_start + r.n_words]


def test_sliding_least_is_leftmost():
    h = np.array([3, 1, 1, 2, 5, 0, 0], dtype=np.uint64)
    assert substring.sliding_least(h, 3).tolist() == [1, 1, 2, 5, 5]


# --- decontamination --------------------------------------------------------------------------

def test_default_mask_is_lossless():
    import itertools

    span = decontam.WINDOW
    for bad in itertools.combinations(range(span), decontam.SUBSTITUTIONS):
        assert any(all(m[i] == "0" or o + i not in bad for i in range(len(m))) for m in decontam.MASKS for o in range(span - len(m) + 1)), bad


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n, 400)) for i, n in enumerate((5, 8, 10, 13, 14, 30))] + [(90, None), (91, "")]
    rows = []
    for i in range(50):
        w = prose(rng, rng.randrange(0, 60), 400).split()
        if i % 2:
            item = rng.choice(items[:6])[1].split()
            for _ in range(rng.randrange(4)):
                item[rng.randrange(len(item))] = "ZZ"
            w[rng.randrange(len(w) + 1) : 0] = item
            w = [x.upper() + rng.choice(["", ",", "."]) for x in w]
        rows.append((i, " ".join(w)))
    rows.append((60, None))

    def toks(t):
        return [x for x in re.split(r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", (t or "").lower()) if x]

    want = set()
    for d, t in rows:
        a = toks(t)
        for k, s in items:
            b = toks(s)
            span = min(len(b), 13)
            if span >= 8 and any(sum(x == y for x, y in zip(a[i : i + span], b[j : j + span])) >= (11 if len(b) >= 13 else span) for j in range(len(b) - span + 1) for i in range(len(a) - span + 1)):
                want.add((d, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(documents(spark, rows, extra=True), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    clean = {r.doc_id for r in decontam.decontaminate(documents(spark, rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.contaminated(documents(spark, rows).limit(0), bench).count() == 0
    assert decontam.contaminated(documents(spark, rows), bench.limit(0)).count() == 0


# --- mixing -----------------------------------------------------------------------------------

def test_mix_reaches_targets(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 30)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(2000)]
    rows += [(5000, None, "en", "b", 0), (5001, "", "en", "d", 0)]
    got = mixing.mix(documents(spark, rows), bucket_rows=50).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(documents(spark, rows).repartition(7), bucket_rows=500).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    for _, part in got.groupby(got.source.fillna("~")):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 60
        assert part.target.iloc[0] <= 2 * part.source_size.iloc[0] + 1e-9
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 60
    assert mixing.mixed_documents(documents(spark, rows)).count() == got.copies.sum()


def test_mix_edge_cases(spark):
    assert mixing.mix(documents(spark, [(1, "a", "", "", 0)]).limit(0)).count() == 0
    got = mixing.mix(documents(spark, [(1, "a b", "", "s", 0), (1, "a b", "", "s", 0), (2, None, "", None, 0)])).toPandas()
    assert len(got) == 3 and got.taken.sum() <= 6 and got.target.max() <= 8


# --- classifiers ------------------------------------------------------------------------------

def labelled(spark, rows):
    return spark.createDataFrame([(d, q, t) for d, _, q, t in rows], "doc_id long, quality int, toxic int")


def classified(spark, n=600):
    rng, rows = random.Random(10), []
    for i in range(n):
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        w = prose(rng, rng.randrange(20, 60)).split()
        if toxic:
            w[rng.randrange(len(w)) : 0] = rng.sample(["grumf", "blarg", "snork"], 2)
        t = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, t, good, toxic))
    return documents(spark, [(d, t) for d, t, _, _ in rows]), labelled(spark, rows), {d: (q, t) for d, _, q, t in rows}


def accuracy(result, truth, which):
    held = [r for r in result.collect() if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in held)
    return sum(r.predicted == truth[r.doc_id][which] for r in held) / len(held)


def test_classifiers_on_held_out_documents(spark):
    docs, labels, truth = classified(spark)
    tox, qual = toxicity.toxicity(docs, labels), quality.quality(docs, labels)
    assert accuracy(tox, truth, 1) > 0.95
    assert accuracy(qual, truth, 0) > 0.95
    assert {r.doc_id for r in tox.where("held_out").collect()} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert {r.doc_id for r in qual.where("held_out").collect()} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    kept = {r.doc_id for r in toxicity.non_toxic(docs, labels).collect()}
    assert sum(t for d, (_, t) in truth.items() if d in kept) <= 5


def test_held_out_labels_are_not_learnt(spark):
    docs, labels, truth = classified(spark, 200)
    from pyspark.sql import functions as F

    from faultline.llm.sample import fold

    lies = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(tuple(r) for r in toxicity.toxicity(docs, labels).collect())
    assert a == sorted(tuple(r) for r in toxicity.toxicity(docs, lies).collect())


def test_classifier_edge_cases(spark):
    docs = documents(spark, EDGE, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (toxicity.toxicity(docs, none), quality.quality(docs, none)):
        assert [r.score for r in result.collect()] == [0.0] * len(EDGE) or max(r.score for r in result.collect()) < 1e-9
    ones = spark.createDataFrame([(d, 1, 1) for d, _ in EDGE if d], "doc_id long, quality int, toxic int")
    assert min(r.score for r in quality.quality(docs, ones).collect()) == 1.0
    assert toxicity.toxicity(docs.limit(0), ones).count() == 0 and quality.quality(docs.limit(0), ones).count() == 0
