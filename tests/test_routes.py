"""Paths from all vertices in blocks of roots: against plain walks, and without rounds of joins."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import kernels, routes
from faultline.graph import Graph
from faultline.operators import contagion, features, metrics, paths
from faultline.plans import iterate


def rows(seed=3, n=30, parts=3):
    """Random links in parts that aren't connected, with a self-loop."""
    rng = random.Random(seed)
    ends = {(p * 100 + rng.randrange(n - 8 * p), p * 100 + rng.randrange(n - 8 * p)) for p in range(parts) for _ in range(n + n // 3)} | {(5, 5)}
    return [(f"{a:04d}", f"{b:04d}", float(rng.randrange(1, 4))) for a, b in sorted(ends)]


@pytest.fixture
def g(spark, monkeypatch):
    """Blocks of a few roots; a written state, as rounds of joins need one each, fails."""
    e = spark.createDataFrame(rows(), "src string, dst string, weight double").cache()
    v = spark.createDataFrame([(x,) for x in sorted({x for r in rows() for x in r[:2]}) + ["9999"]], "id string").cache()

    def no_state(*a, **k):
        raise AssertionError("a round of joins")

    monkeypatch.setattr(paths, "cut", no_state)
    monkeypatch.setattr(paths, "least_reachable", no_state)
    monkeypatch.setattr(routes, "CELLS", 200)
    return Graph.from_edges(e, vertices=v)


def near(directed=True):
    out = collections.defaultdict(dict)
    for a, b, w in rows():
        out[a][b] = w
        if not directed:
            out[b][a] = w
    return {v: list(x.items()) for v, x in out.items()}


VERTICES = [*sorted({x for r in rows() for x in r[:2]}), "9999"]


def to(root, directed=True):
    return kernels.distances(root, near(directed))


def test_bfs_needs_no_rounds(g):
    got = sorted((r.root, r.id, r.dist) for r in paths.bfs(g).collect())
    assert got == sorted((v, x, d) for v in VERTICES for x, d in to(v).items())


def inward():
    out = {v: [] for v in VERTICES}
    for v in VERTICES:
        for x, d in to(v).items():
            if d:
                out[x].append(d)
    return out


def test_closeness_needs_no_pairs(g, monkeypatch):
    monkeypatch.setattr(paths, "bfs", None)
    got = {r.id: r.closeness for r in paths.closeness(g).collect()}
    assert got == {v: pytest.approx(len(d) / sum(d) * len(d) / (len(VERTICES) - 1) if d else 0.0) for v, d in inward().items()}


def test_contagion_index_needs_no_pairs(g, monkeypatch):
    monkeypatch.setattr(paths, "bfs", None)
    got = {r.id: r.contagion_index for r in contagion.contagion_index(g).collect()}
    assert got == {v: pytest.approx((len(to(v)) - 1) / len(VERTICES), abs=1e-6) for v in VERTICES}


def test_harmonic_needs_no_pairs(g, monkeypatch):
    monkeypatch.setattr(paths, "bfs", None)
    got = {r.id: r.harmonic for r in paths.harmonic(g).collect()}
    assert got == {v: pytest.approx(sum(1 / x for x in d)) for v, d in inward().items()}


def test_path_lengths_need_no_rounds(g):
    got = paths.path_lengths(g.undirected()).first()
    groups = sorted({frozenset(to(v, False)) for v in VERTICES}, key=lambda s: (-len(s), min(s)))
    d = [x for v in groups[0] for x in to(v, False).values() if x]
    assert (got.n_components, got.diameter) == (len(groups), max(d))
    assert (got.lcc_fraction, got.avg_path_length) == (pytest.approx(len(groups[0]) / len(VERTICES)), pytest.approx(sum(d) / len(d)))


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_goes_by_blocks(g, monkeypatch, directed):
    want = collections.Counter()
    for v in VERTICES:
        want.update(kernels.dependencies(v, near(directed)))
    monkeypatch.setattr(kernels, "dependencies", None)  # root by root
    n = len(VERTICES)
    got = {r.id: r.betweenness for r in paths.betweenness(g if directed else g.undirected()).collect()}
    assert got == {v: pytest.approx(want[v] / (n - 1) / (n - 2)) for v in VERTICES}


def test_weighted_betweenness_goes_by_blocks(g, monkeypatch):
    want = collections.Counter()
    for v in VERTICES:
        want.update(kernels.dependencies(v, near(), True))
    monkeypatch.setattr(kernels, "dependencies", None)  # root by root
    n = len(VERTICES)
    got = {r.id: r.betweenness for r in paths.betweenness(g, weighted=True).collect()}
    assert got == {v: pytest.approx(want[v] / (n - 1) / (n - 2)) for v in VERTICES}


def test_removals_take_one_walk_a_component(g, monkeypatch):
    monkeypatch.setattr(kernels, "per_vertex", None)  # a walk a vertex

    def largest(gone=None):
        left, best = set(VERTICES) - {gone}, 0
        while left:
            queue, size = [left.pop()], 0
            while queue:
                size += 1
                for x, _ in near(False).get(queue.pop(), ()):
                    if x in left:
                        left.remove(x)
                        queue.append(x)
            best = max(best, size)
        return best

    got = {r.id: r.contagion_index for r in contagion.contagion_index(g.undirected()).collect()}
    assert got == {v: pytest.approx((largest() - largest(v)) / len(VERTICES), abs=1e-6) for v in VERTICES}
    assert len(set(got.values())) > 2


def test_node_features_need_no_rounds(g, monkeypatch):
    monkeypatch.setattr(metrics, "cut", None)
    n, ix = len(VERTICES), {v: i for i, v in enumerate(VERTICES)}
    a = np.zeros((n, n))
    for s, d, _ in rows():
        a[ix[s], ix[d]] = 1
    out, x = a.sum(1), np.full(n, 1 / n)
    for _ in range(100):
        new = 0.85 * ((x[out > 0] / out[out > 0]) @ a[out > 0] + x[out == 0].sum() / n) + 0.15 / n
        x, moved = new, np.abs(new - x).sum()
        if moved < n * 1e-6:
            break
    got = {r.id: r.pagerank for r in features.node_features(g).collect()}
    assert got == {v: pytest.approx(x[ix[v]], rel=1e-5) for v in VERTICES}


def test_parts_of_systemic_importance_need_no_rounds(g, monkeypatch):
    monkeypatch.setattr(metrics, "cut", None)
    links = {v: {x for x, _ in near(False).get(v, ()) if x != v} for v in VERTICES}
    core, k = {}, 0
    while links:
        v = min(links, key=lambda x: len(links[x]))
        k = max(k, len(links[v]))
        core[v] = k
        for x in links.pop(v):
            links[x].discard(v)
    assert {r.id: r.coreness for r in metrics.coreness(g).collect()} == core and max(core.values()) > 1
    ix = {v: i for i, v in enumerate(VERTICES)}
    x = np.full(len(ix), 1 / len(ix))
    for _ in range(10):
        y = x.copy()
        for v, n in near(False).items():
            for u, _ in n:
                y[ix[u]] += x[ix[v]]
        x = y / np.sqrt(y @ y)
    assert {r.id: r.eigenvector for r in metrics.eigenvector(g, rounds=10, tol=None).collect()} == {v: pytest.approx(x[ix[v]]) for v in VERTICES}


def test_centralities_write_no_round(g, monkeypatch):
    """Katz writes its state and the arcs of the radius once; nothing is written round by round."""
    written = []
    real = iterate.cut
    for m in (metrics, features):
        monkeypatch.setattr(m, "cut", lambda df, *a: written.append(1) or real(df))
    got = {r.id: r for r in features.centralities(g).collect()}
    assert len(written) <= 4 and len(got) == len(VERTICES)
    n = len(VERTICES)
    assert {v: r.harmonic for v, r in got.items()} == {v: pytest.approx(sum(1 / x for x in d)) for v, d in inward().items()}
    ix = {v: i for i, v in enumerate(VERTICES)}
    both, one = np.zeros((n, n)), np.zeros((n, n))
    for (a, b), w in {(min(s, d), max(s, d)): w for s, d, w in sorted(rows())}.items():
        both[ix[a], ix[b]] = both[ix[b], ix[a]] = w
    for s, d, w in rows():
        one[ix[s], ix[d]] = w
    x = np.linalg.solve(np.eye(n) - one.T / (1.1 * np.linalg.eigvalsh(both).max()), np.ones(n))
    assert {v: r.katz for v, r in got.items()} == {v: pytest.approx(x[ix[v]] / np.linalg.norm(x), rel=1e-3) for v in VERTICES}


def test_failure_risk_computes_its_features_once(g, monkeypatch):
    """Scaling, fitting and scoring read what was written once."""
    plans, real = [], features._model

    class Spy:
        def __init__(self, model):
            self.model = model

        def fit(self, data):
            plans.append(data._jdf.queryExecution().optimizedPlan().toString())
            return self.model.fit(data)

    monkeypatch.setattr(features, "_model", lambda *a: Spy(real(*a)))
    monkeypatch.setattr(metrics, "cut", None)
    failed = g.vertices.where("id < '0010'").select("id")
    assert features.failure_risk(g, failed).count() == len(VERTICES)
    assert "Join" not in plans[0] and "MapInArrow" not in plans[0]


def test_weighted_arcs_are_walked_little_more_than_once(monkeypatch):
    rng = np.random.default_rng(5)
    n, m = 2000, 8000
    src, dst = np.sort(rng.integers(0, n, m)), rng.integers(0, n, m)
    w = routes.Walk(0, n, np.searchsorted(src, np.arange(n + 1)), dst, rng.uniform(0.1, 10.0, m))
    reached = sum(len(c) for c in routes.levels(w, 7, 8))
    arcs, walked, out = reached * m / n, [], routes.Walk.out
    monkeypatch.setattr(routes.Walk, "out", lambda self, cells: walked.append(out(self, cells)) or walked[-1])
    got = routes.dependencies(w, 7, 8, weighted=True)
    assert sum(len(which) for which, _, _ in walked) < 1.5 * arcs  # 3.3 times when every frontier was walked from at once
    monkeypatch.undo()
    adj = {v: list(zip(w.dst[i:j].tolist(), w.weight[i:j].tolist())) for v, (i, j) in enumerate(zip(w.first.tolist(), w.first[1:].tolist()))}
    want = kernels.dependencies(7, adj, True)
    assert got == pytest.approx([want.get(v, 0.0) for v in range(n)], rel=1e-9)


def test_weighted_ties_of_paths_with_more_steps():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n, m = 25, 90
        ends = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))})
        src, dst = (np.array(x) for x in zip(*ends))
        w = routes.Walk(0, n, np.searchsorted(src, np.arange(n + 1)), dst, rng.integers(1, 5, len(ends)).astype(float))
        adj = {v: list(zip(w.dst[i:j].tolist(), w.weight[i:j].tolist())) for v, (i, j) in enumerate(zip(w.first.tolist(), w.first[1:].tolist()))}
        want = collections.Counter()
        for root in range(n):
            want.update(kernels.dependencies(root, adj, True))
        assert routes.dependencies(w, 0, n, weighted=True) == pytest.approx([want[v] for v in range(n)])


def test_scenarios_need_no_rounds_and_no_row_a_vertex(spark, monkeypatch):
    e = spark.createDataFrame([r for r in rows() if r[0] != r[1]], "src string, dst string, weight double").cache()
    g = Graph.from_edges(e)
    g = Graph(g.vertices.withColumn("capital", F.lit(1.0)), g.edges)
    monkeypatch.setattr(routes, "fits", lambda g: False)
    want = sorted(map(tuple, features.shock_scenarios(g, n=12, seeds=2).collect()))
    monkeypatch.undo()

    def no_rounds(*a, **k):
        raise AssertionError("a round of joins")

    monkeypatch.setattr(features, "threshold_contagion", no_rounds)
    scenarios = iterate.cut(features.shock_scenarios(g, n=12, seeds=2))
    assert sorted(map(tuple, scenarios.collect())) == want
    fitted, fit = [], features.LogisticRegression.fit
    monkeypatch.setattr(features.LogisticRegression, "fit", lambda self, d: fitted.append(d.count()) or fit(self, d))
    prob = features.train_scenarios(g, scenarios)[1]
    assert prob.count() == scenarios.count() and 0 < max(fitted) < scenarios.count() / 2
