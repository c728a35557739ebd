"""Every stage of the pipeline against brute force, and on nulls, empty and long texts, repeats, ties, empty tables, odd columns."""

import collections
import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from faultline.llm import mixing, toxicity
from faultline.llm.sample import labelled_features

from .test_text_operators import linked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
ITEM = " ".join(f"item{i}" for i in range(20))


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), spark.read.parquet(f"{folder}/documents.parquet")


def bag(rows):
    return collections.Counter(map(repr, map(tuple, rows)))


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    base = [prose(rng, rng.choice([30, 60, 90])) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, f"{prose(rng, 20)} grumf blarg {prose(rng, 20)}", "en", "s0", 1) for i in range(40)]
    rows += [(200 + i, base[i] + " tail", "de", "s1", 2) for i in range(10)]
    rows += [(300 + i, f"{base[i + 20]} {ITEM} {prose(rng, 5)}", "en", "s2", 3) for i in range(5)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (None, prose(rng, 40), "en", None, 1), (None, prose(rng, 40), None, "s1", 1), (5, prose(rng, 30), "en", "s1", 1)]
    rows += [rows[0], rows[0], (402, prose(rng, 60_000), "en", "s2", 9)]
    labels = [(d, 1, int(100 <= d < 200)) for d, *_ in rows if d is not None and d < 200] + [(None, 1, 1), (7, None, None)]
    folder, docs = tables(spark, tmp_path_factory.mktemp("corpus"), rows, labels, [(0, ITEM), (1, None), (2, "")])
    return folder, docs, rows


def test_toxicity_drops_what_the_model_rejects(spark, corpus):
    folder, docs, rows = corpus
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    from pyspark.sql import functions as F

    model = toxicity.fit(*labelled_features(docs, labels, "toxic", F.lit(True), toxicity.packed_terms))
    scores = model.score_texts(pa.array([r[1] for r in rows], pa.string()))
    want = [r for r, s in zip(rows, scores) if s < 0.7]
    got = STAGES["toxicity"](spark, docs, folder)
    assert bag(got.collect()) == bag(want) and got.columns == docs.columns
    assert {r[0] for r in rows} - {r[0] for r in want} == set(range(100, 140))


def test_near_duplicates_leave_one_of_each_group(spark, corpus):
    folder, docs, rows = corpus
    got = collections.Counter(map(tuple, STAGES["near_duplicates"](spark, docs, folder).collect()))
    keys = list(enumerate(rows))
    groups = collections.defaultdict(list)
    for (k, n, c), m in linked([(k, r[1]) for k, r in keys], 5, 80, 100).items():
        groups[c if n else ("alone", k)].append(k)
    want = collections.Counter()
    for members in groups.values():
        want[rows[min(members, key=lambda k: (rows[k][0] is None, rows[k][0], k))]] += 1
    assert got == want


def test_decontamination_drops_what_holds_an_item(spark, corpus):
    folder, docs, rows = corpus
    words = lambda t: " " + " ".join(re.findall(r"[a-z0-9]+", (t or "").lower())) + " "
    want = [r for r in rows if f" {ITEM} " not in words(r[1])]
    got = STAGES["decontamination"](spark, docs, folder)
    assert bag(got.collect()) == bag(want) and len(want) == len(rows) - 5


def finish_order(rows, weights=(3, 1, 2)):
    """Copies a row by brute force: every copy's finish time, one sorted list, cut at the budget."""
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    budget = 1.5 * sum(size)
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    open_, target = set(sources), {}
    while True:
        rest = budget - sum(target.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    return size, total, target, budget


def test_mixing_takes_each_source_to_its_target(spark, corpus):
    folder, docs, rows = corpus
    size, total, target, budget = finish_order(rows)
    out = STAGES["mixing"](spark, docs, folder)
    got = collections.Counter(map(tuple, out.collect()))
    given = collections.Counter(rows)
    assert out.columns == docs.columns and set(got) <= set(given)
    count = dict(zip(rows, size))
    assert all(got[r] <= 2 * n for r, n in given.items()) and not any(n == 0 and got[r] for r, n in count.items())
    largest = max(size)
    for s, wanted in target.items():
        assert abs(sum(n * count[r] for r, n in got.items() if r[3] == s) - wanted) <= largest
    assert sum(n * count[r] for r, n in got.items()) <= budget


def test_mixed_documents_agree_with_the_mix(spark, corpus):
    """The places of sources tell the same as the mix's own counts, whatever columns there are."""
    _, docs, rows = corpus
    odd = docs.selectExpr("*", "n_chars as size", "lang as number", "1 as `__place`", "2 as bucket", "3 as upto")
    plan = mixing.mix(odd)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    got = collections.Counter((r.doc_id, r.source) for r in out.collect())
    want = collections.Counter()
    for r in plan.collect():
        want[r.doc_id, r.source] += r.copies
    assert got == +want
    again = collections.Counter((r.doc_id, r.text) for r in mixing.mixed_documents(odd.repartition(5)).collect())
    assert again == collections.Counter((r.doc_id, r.text) for r in out.collect())


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c", "en", "s", 7), (1, "d e f", "en", "s", 7), (None, "g h i", "en", "s", 7), (None, "j k l", "en", "s", 7), (2, "x y z", "en", "t", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = bag(mixing.mixed_documents(docs).collect())
    assert first == bag(mixing.mixed_documents(docs.repartition(3)).collect())
    assert sum(first.values()) == sum(r.copies for r in mixing.mix(docs).collect())


def test_odd_columns_pass_through(spark, corpus):
    folder, docs, rows = corpus
    odd = docs.selectExpr("*", "'x' as label", "2 as score", "3 as node", "4 as seed", "6 as comp", "7 as size", "8 as item_id", "9 as kept")
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        got = STAGES[name](spark, odd, folder)
        assert got.columns == odd.columns, name
        assert {(r.label, r.score, r.node, r.seed, r.comp, r.size, r.item_id, r.kept) for r in got.collect()} == {("x", 2, 3, 4, 6, 7, 8, 9)}, name


def test_empty_tables(spark, corpus, tmp_path):
    folder, docs, rows = corpus
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    bare, docs = tables(spark, tmp_path, rows[:20], [], [])
    assert bag(STAGES["toxicity"](spark, docs, bare).collect()) == bag(rows[:20])
    assert bag(STAGES["decontamination"](spark, docs, bare).collect()) == bag(rows[:20])


def test_tokens_hold_every_row_of_the_mix(spark, corpus):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from faultline.llm.queries import vocabulary_path

    folder, docs, rows = corpus
    t = Tokenizer.from_file(vocabulary_path())
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    got = STAGES["tokens"](spark, docs, folder).collect()
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag((r[0], len(i), zlib.crc32(np.array(i, "<u4"))) for r, i in zip(rows, ids))
    assert sorted(r.start for r in got)[-1] < sum(map(len, ids))


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, docs, _ = corpus
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert bag(corpus_pipeline.run(spark, folder).collect()) == bag(docs.collect())
