"""Variants that the registered queries don't choose: other strategies, directions, centralities."""

import numpy as np
import pytest

from faultline.graph import Graph
from faultline.operators import contagion, metrics, multilayer, structure, temporal


def graph(spark, edges, directed=True):
    return Graph.from_edges(spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in edges], "src string, dst string, weight double"), directed)


def test_distress_spreads_once_or_until_it_rests(spark):
    """A chain a -> b -> c with half of b's weight elsewhere."""
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("b", "d", 1)])
    seeds = spark.createDataFrame([("a",)], "id string")
    once = {r.id: r.debtrank for r in contagion.debtrank(g, seeds, 0.6, battiston=True).collect()}
    assert once == {"a": 0.6, "b": 0.6, "c": 0.3, "d": 0.3}
    # Levels of the round before last: each round b takes a's 0.6 again, until it is at 1.
    h, prev = {"a": 0.6, "b": 0.0, "c": 0.0, "d": 0.0}, {"a": 0.6, "b": 0.0, "c": 0.0, "d": 0.0}
    for _ in range(50):
        new = {"a": h["a"], "b": min(1.0, h["b"] + prev["a"]), "c": min(1.0, h["c"] + prev["b"] / 2), "d": min(1.0, h["d"] + prev["b"] / 2)}
        new = {k: 1.0 if h[k] >= 1 else v for k, v in new.items()}
        if max(abs(new[k] - prev[k]) for k in new) < 1e-6:
            break
        h, prev = new, h
    assert {r.id: r.debtrank for r in contagion.debtrank(g, seeds, 0.6).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in h.items()}


def test_attacks_follow_their_scores(spark):
    g = graph(spark, [("a", "h", 1), ("b", "h", 1), ("h", "c", 1), ("c", "d", 1)])
    first = lambda s: structure.attack_order(g, s).where("rank = 1").first().id
    assert first("degree") == "h" and first("betweenness") in ("h", "c") and first("pagerank") == "d"
    trials = structure.attack_order(g, "random", trials=3)
    assert trials.count() == 15 and trials.groupBy("trial").count().where("count = 5").count() == 3
    half = structure.attack_curve(g.undirected(), structure.attack_order(g, "degree"), 0.5)
    assert half.count() == 2


def test_directed_assortativity_pairs_out_with_in(spark):
    edges = [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("d", "b", 1)]
    out, into = {}, {}
    for s, d, _ in edges:
        out[s], into[d] = out.get(s, 0) + 1, into.get(d, 0) + 1
    want = np.corrcoef([out[s] for s, _, _ in edges], [into[d] for _, d, _ in edges])[0, 1]
    assert metrics.assortativity(graph(spark, edges)).first()[0] == pytest.approx(want)


def test_snapshot_centralities(spark):
    """A path a-b-c in one snapshot, nothing in the other."""
    edges = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "c", 1.0)], "snap_id long, a string, b string, weight double")
    assets = spark.createDataFrame([(k, x) for k in (0, 1) for x in "abc"], "snap_id long, id string")
    got = lambda c: {(r.snap_id, r.id): r.value for r in temporal.temporal_centrality(edges, assets, c).collect()}
    near = got("closeness")
    assert near[0, "b"] == pytest.approx(1.0) and near[0, "a"] == pytest.approx(2 / 3) and near[1, "a"] == 0.0
    between = got("betweenness")
    assert between[0, "b"] == pytest.approx(1.0) and between[0, "a"] == 0.0 and between[1, "b"] == 0.0
    eigen = got("eigenvector")
    assert eigen[0, "b"] == pytest.approx(2**-0.5, abs=1e-3) and eigen[0, "a"] == pytest.approx(0.5, abs=1e-3)
    assert got("degree")[0, "b"] == 1.0


def test_directed_layers_are_averaged(spark):
    rows = [("x", True, "a", "b", 4.0), ("x", True, "b", "c", 2.0), ("y", False, "a", "b", 1.0)]
    m = multilayer.Multiplex.of(spark.createDataFrame(rows, multilayer.LAYERS))
    cells = {(r.i, r.j): r.v for r in multilayer.supra_adjacency(m).collect()}
    assert cells[0, 1] == cells[1, 0] == 2.0 and cells[1, 2] == 1.0 and cells[3, 4] == 1.0 and cells[0, 3] == 1.0
    assert {(r.i, r.j): r.v for r in multilayer.supra_adjacency(m, directed=True).collect()}[0, 1] == 4.0
    fused = {(r.a, r.b): r.weight for r in multilayer.fuse_weighted(m).collect()}
    assert fused == {("a", "b"): 1.0, ("b", "c"): 0.25}
    own = multilayer.fuse_weighted(m, spark.createDataFrame([("x", 3.0), ("y", 1.0)], "layer string, w double"))
    assert {(r.a, r.b): r.weight for r in own.collect()} == {("a", "b"): 1.0, ("b", "c"): 0.375}
    score = {r.layer: r.score for r in multilayer.layer_importance(m).collect()}
    assert score["y"] == pytest.approx(1.0, abs=1e-6) and score["x"] == 0.0  # a directed layer without cycles has radius 0
