"""Entries that no registered query calls: sinks, adapters, reports, exports."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions import stats
from faultline.graph import Graph
from faultline.operators import contagion, dependency, embedding, features, metrics, multilayer, paths, structure, temporal
from faultline.plans import facade
from faultline.sources import network, returns as series


def graph(spark, edges, directed=True):
    return Graph.from_edges(spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in edges], "src string, dst string, weight double"), directed)


@pytest.fixture(scope="module")
def shipped(spark, tmp_path_factory):
    """A CSV of two triangles and a bridge."""
    folder = tmp_path_factory.mktemp("net")
    rows = ["a,b,3", "b,c,2", "c,a,4", "d,e,1", "e,f,2", "f,d,5", "c,d,1"]
    (folder / "net.csv").write_text("source,target,exposure\n" + "\n".join(rows) + "\n")
    return str(folder / "net.csv")


def test_contagion_run_reports_everything(spark, shipped):
    r = facade.contagion_run(spark, shipped, "degree:1", threshold=0.4)
    assert [x.id for x in r["seeds"].collect()] == ["c"]
    assert {x.id for x in r["contagion"].collect()} >= {"c", "b"}
    over = r["over_time"].orderBy("step").collect()
    assert over[-1].cumulative == r["contagion"].count()
    assert r["global_before"].first().n_nodes == 6 and r["global_after"].first().n_nodes == 6 - r["contagion"].count()
    m = {x.id: x for x in r["node_metrics"].collect()}
    assert m["c"].degree == 3 and m["c"].capital > 0 and m["c"].betweenness == pytest.approx(12 / 20)
    assert facade.contagion_run(spark, shipped, initial=["zzz"])["seeds"].count() == 1  # none known: one at random


def test_bundles_of_the_command_line(spark, shipped):
    g = network.load_network(spark, shipped)
    row = facade.global_bundle(g).first().asDict()
    assert row["num_nodes"] == 6 and row["num_edges"] == 7 and row["density"] == pytest.approx(14 / 30) and row["avg_clustering"] == pytest.approx((4 + 2 / 3) / 6)
    assert row["avg_shortest_path_length"] == pytest.approx(1.8)
    apart = facade.global_bundle(graph(spark, [("a", "b", 1), ("x", "y", 1)])).first()
    assert apart.avg_shortest_path_length is None
    head = facade.headline_bundle(g).first().asDict()
    assert head["Number of Banks"] == 6 and head["Number of Exposures"] == 7 and head["Density"] == pytest.approx(7 / 30) and head["Average Degree"] == pytest.approx(14 / 6)
    nodes = {r.Node: r for r in facade.node_bundle(g).collect()}
    assert nodes["c"].Degree == 3 and nodes["a"].Clustering == 1.0 and facade.node_bundle(g).columns == ["Node", "Degree", "Betweenness", "Eigenvector", "Clustering"]


def test_network_report_and_global_metrics(spark, shipped):
    g = network.load_network(spark, shipped).undirected()
    r = facade.network_report(g)
    one = r["global"].first()
    assert (one.n_nodes, one.n_components, one.diameter) == (6, 1, 3) and one.transitivity == pytest.approx(6 / 10)
    assert r["centrality"].count() == 6 and r["top_nodes"].count() == 5 and r["modularity"].first().q > 0
    assert r["communities"].select("community").distinct().count() == 2
    assert 0 < r["robustness"].first().r < 1 and r["spectral"].first().spectral_gap > 0


def test_sinks_write_what_they_are_given(spark, shipped, tmp_path):
    g = network.load_network(spark, shipped)
    risk = spark.createDataFrame([("a", 0.25)], "node string, failure_prob double")
    network.write_node_metrics(features.node_metrics(g), f"{tmp_path}/m", risk)
    back = {r.id: r for r in spark.read.option("header", True).csv(f"{tmp_path}/m").collect()}
    assert len(back) == 6 and back["a"].gnn_failure_prob == "0.25" and back["b"].gnn_failure_prob is None
    network.write_risks(risk, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").collect()[0].asDict() == {"node": "a", "failure_prob": "0.25"}


def test_demo_network_has_no_lonely_vertices(spark):
    g = network.demo_network(spark)
    ends = {x for r in g.edges.collect() for x in (r.src, r.dst)}
    assert {r.id for r in g.vertices.collect()} == ends and all(0.1 <= r.weight <= 1.0 for r in g.edges.collect())


def test_seeds_resolve_as_asked(spark):
    g = graph(spark, [("A", "b", 1), ("b", "c", 1), ("b", "d", 1)])
    pick = lambda **k: sorted(r.id for r in contagion.initial_failures(g, **k).collect())
    assert pick(attack="degree:1") == ["b"] and pick(attack="top_betweenness:1") == ["b"] and pick(attack="top_eigen:1") == ["b"]
    assert pick(attack="a,zzz, C") == ["A", "c"] and pick(attack="degree:x") == [] and len(pick(attack="random:2")) == 2 and len(pick(attack="random")) == 1
    assert pick(initial=["b", "nobody"]) == ["b"] and len(pick(initial=["nobody"])) == 1 and len(pick()) == 1


def test_pandas_series_and_wide_frames(spark):
    frame = pd.DataFrame({"x": [1.0, float("nan"), 3.0], "y": [4.0, 5.0, 6.0]}, index=pd.date_range("2020-01-01", periods=3))
    long = series.from_pandas(spark, frame)
    assert long.count() == 5 and {r.asset for r in long.collect()} == {"x", "y"}
    assert series.to_wide(long).columns == ["t", "x", "y"]


def test_correlated_series_have_their_covariance(spark):
    want = np.array([[1.0, 0.6, 0.0], [0.6, 1.0, -0.3], [0.0, -0.3, 0.5]])
    r = series.correlated(spark, want.tolist(), 4000, seed=3).toPandas().pivot(index="t", columns="asset", values="r")
    assert list(r.columns) == ["Asset_1", "Asset_2", "Asset_3"] and np.abs(np.cov(r.to_numpy().T) - want).max() < 0.08
    with pytest.raises(ValueError):
        series.correlated(spark, [[1.0, 2.0], [2.0, 1.0]], 5)


@pytest.fixture(scope="module")
def interface(spark):
    cov = [[1.0, 0.9, 0.8, 0.0], [0.9, 1.0, 0.7, 0.0], [0.8, 0.7, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    r = series.correlated(spark, cov, 200, seed=5)
    ext = spark.createDataFrame([("Asset_1", 1.5, "x"), ("Asset_9", 2.0, "y")], "id string, rsi double, name string")
    return facade.graph_interface(r, ext)


def test_summary_has_every_layer(interface):
    rows = {r.layer: r for r in interface.summary().collect()}
    assert set(rows) == {"pearson", "spearman", "partial", "mst", "pmfg", "spectral", "granger", "mutual_info", "transfer_entropy", "fused_eigen", "fused_intersect"}
    assert rows["pearson"].edges == 3 and rows["mst"].edges == 2 and rows["granger"].directed and not rows["pearson"].directed


def test_exports_agree_with_the_layer(interface):
    g = interface.graph("pearson")
    e = {(r.src, r.dst): r.weight for r in g.edges.collect()}
    cells = {(r.i, r.j): r.v for r in interface.adjacency("pearson").collect()}
    place = {f"Asset_{k + 1}": k for k in range(4)}
    assert cells == {k: v for (a, b), w in e.items() for k, v in (((place[a], place[b]), w), ((place[b], place[a]), w))}
    own = {(r.i, r.j): r.v for r in interface.adjacency("pearson", ["Asset_2", "Asset_1"]).collect()}
    assert own == {(0, 1): e["Asset_1", "Asset_2"], (1, 0): e["Asset_1", "Asset_2"]}
    with pytest.raises(KeyError):
        interface.adjacency("pearson", ["nobody"])
    with pytest.raises(KeyError):
        interface.graph("nothing")
    ix = {(r.src_ix, r.dst_ix): r.weight for r in interface.edge_index("pearson").collect()}
    assert ix == {k: pytest.approx(v, rel=1e-6) for k, v in cells.items()}
    f = {r.id: r for r in interface.node_features("pearson").collect()}
    assert f["Asset_1"].rsi == 1.5 and f["Asset_2"].rsi == 0.0 and "name" not in interface.node_features("pearson").columns and f["Asset_1"].degree == 2
    assert interface.node_features("pearson", False, False).columns == ["id", "degree"]
    assert interface.node_features("pearson", False).columns == ["id", "rsi"]
    snaps, edges = interface.temporal(60, 70)
    assert snaps.count() == 3 and edges.count() >= 6


def test_layers_come_and_go(spark):
    m = multilayer.Multiplex.of(spark.createDataFrame([("x", False, "a", "b", 2.0)], multilayer.LAYERS))
    m = m.add_layer("y", graph(spark, [("b", "c", 1)])).add_layer("z", Graph(spark.createDataFrame([("q",)], "id string"), m.layers.select("src", "dst", "weight").limit(0), False))
    assert {r.layer: (r.nodes, r.edges) for r in multilayer.layer_summary(m).collect()} == {"x": (2, 1), "y": (2, 1), "z": (0, 0)}
    assert {(r.src, r.dst) for r in m.adjacency("x").collect()} == {("a", "b"), ("b", "a")} and m.layer("y").directed
    gone = m.remove_layer("x")
    assert {r.layer for r in gone.layer_names().collect()} == {"y", "z"} and gone.vertices.count() == 4


def test_snapshots_to_columns_and_vectors(spark):
    values = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)], "snap_id long, id string, value double")
    assert sorted(map(tuple, temporal.wide(values).collect())) == [(0, 1.0, 2.0), (1, 3.0, 0.0)]
    edges = spark.createDataFrame([(0, "a", "b", 1.0), (1, "a", "c", 1.0)], "snap_id long, a string, b string, weight double")
    v = embedding.embed_snapshots(edges, dim=4, length=5, walks=2).collect()
    assert {(r.snap_id, r.id) for r in v} == {(0, "a"), (0, "b"), (1, "a"), (1, "c")} and all(len(r.vec) == 4 for r in v)


def test_own_builder_makes_the_snapshots(spark):
    r = series.simulated(spark, 3, 80)
    _, edges = temporal.sliding_snapshots(r, 40, 40, builder=lambda frame, threshold: pd.DataFrame([("x", "y", float(len(frame)))], columns=["a", "b", "weight"]))
    assert sorted((e.snap_id, e.a, e.b, e.weight) for e in edges.collect()) == [(0, "x", "y", 40.0), (1, "x", "y", 40.0)]


def test_online_graph_and_laplacian(spark):
    r = series.correlated(spark, [[1.0, 0.95], [0.95, 1.0]], 300, seed=1)
    e = temporal.ewm_graph(r).collect()
    assert [(x.a, x.b) for x in e] == [("Asset_1", "Asset_2")] and 0.8 < e[0].weight <= 1
    cells = {(x.a, x.b): x.v for x in dependency.laplacian(spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "a string, b string, weight double")).collect()}
    assert cells == {("a", "b"): -2.0, ("b", "a"): -2.0, ("b", "c"): -1.0, ("c", "b"): -1.0, ("a", "a"): 2.0, ("b", "b"): 3.0, ("c", "c"): 1.0}


def test_models_are_saved_and_plots_described(spark, tmp_path):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 2), ("d", "e", 1)])
    g = Graph(g.vertices.withColumn("capital", F.lit(1.0)), g.edges)
    model, prob, metric = features.train_scenarios(g, features.shock_scenarios(g, n=30, seeds=1))
    features.save_model(model, f"{tmp_path}/model")
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(f"{tmp_path}/model").stages and prob.count() == 150 and 0 <= metric["f1"] <= 1
    failed = contagion.threshold_contagion(g, spark.createDataFrame([("d",)], "id string"))
    risk = {k: features.failure_risk(g, failed, k) for k in ("gcn", "sage", "gat")}
    for r in risk.values():
        assert all(0 <= x.failure_prob <= 1 for x in r.collect()) and r.count() == 5
    shown = {x.id: x for x in features.plot_data(g, failed, structure.louvain(g), risk["gcn"]).collect()}
    assert shown["d"].failed and not shown["e"].failed and shown["c"]["size"] == 16 and 0 <= shown["a"].risk <= 1


def test_cutoffs_are_the_p_values(spark):
    for n in (5, 30, 79):
        r = stats.critical_correlation(n, 0.05)
        assert stats.correlation_p(r, n) <= 0.05 < stats.correlation_p(r - 1e-9, n)
    r = series.correlated(spark, [[1.0, 0.4, 0.0], [0.4, 1.0, 0.1], [0.0, 0.1, 1.0]], 60, seed=2)
    every = {(x.a, x.b): x for x in dependency.pearson_graph(r, 0.0, None).collect()}
    kept = {(x.a, x.b) for x in dependency.pearson_graph(r, 0.0, 0.05).collect()}
    assert len(every) == 3 and kept == {k for k, x in every.items() if x.p_value <= 0.05} and ("Asset_1", "Asset_2") in kept


def test_adjusted_p_values_step_up(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.05]
    df = spark.createDataFrame([(float(x),) for x in p], "p_value double")
    plain = {round(r.p_value, 3): r.p_adj for r in dependency.bh_adjust(df).collect()}
    assert plain == {x: pytest.approx(min(1, x * 5 / (sorted(p).index(x) + 1))) for x in p}
    up = {round(r.p_value, 3): r.p_adj for r in dependency.bh_adjust(df, monotone=True).collect()}
    assert up == {x: pytest.approx(min(min(1, y * 5 / (sorted(p).index(y) + 1)) for y in p if y >= x)) for x in p}


def test_a_failing_precision_matrix_falls_back(spark, monkeypatch):
    r = series.correlated(spark, [[1.0, 0.9], [0.9, 1.0]], 80, seed=4)
    same = r.unionByName(r.where("asset = 'Asset_1'").withColumn("asset", F.lit("Asset_3")).withColumn("r", F.lit(0.0)))
    got = dependency.partial_correlation_graph(same, 0.15)
    assert {("Asset_1", "Asset_2")} <= {(x.a, x.b) for x in got.collect()}


def test_removals_are_size_checked(spark, monkeypatch):
    from faultline.functions import kernels

    g = graph(spark, [("a", "b", 1), ("b", "c", 1)], False)
    order = structure.attack_order(g, "degree")
    monkeypatch.setattr(kernels, "MAX_EDGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        structure.attack_curve(g, order)


def test_betweenness_by_joins_equals_the_kernel(spark, monkeypatch):
    from faultline.functions import kernels

    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 25, (60, 2)) if a != b}
    for directed in (True, False):
        g = graph(spark, [(a, b, 1) for a, b in edges if directed or a < b], directed)
        want = {r.id: r.betweenness for r in paths.betweenness(g).collect()}
        got = {r.id: r.betweenness for r in paths.betweenness_by_joins(g, pairs=200).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (0.25, 4.0)])
def test_walks_by_joins_equal_the_kernel(spark, p, q):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1), ("d", "b", 1), ("d", "e", 1)])
    want = sorted((r.id, r.walk, tuple(r.path)) for r in embedding.random_walks(g, 7, 2, p, q).collect())
    assert sorted((r.id, r.walk, tuple(r.path)) for r in embedding.walks_by_joins(g, 7, 2, p, q).collect()) == want


def test_clusters_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from faultline.plans import iterate

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        iterate.shared_folder(fake, "x")
    fake.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        iterate.shared_folder(fake, "x")


def test_katz_default_and_stopping_rules(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 1)])
    rows = g.edges.collect()
    ids = ["a", "b", "c"]
    a = np.zeros((3, 3))
    for r in rows:
        a[ids.index(r.src), ids.index(r.dst)] = r.weight
    u = np.maximum(a, a.T)
    alpha = 1 / (1.1 * np.linalg.eigvalsh(u).max())
    x = np.linalg.solve(np.eye(3) - alpha * a.T, np.ones(3))
    got = {r.id: r.katz for r in metrics.katz(g).collect()}
    assert got == {v: pytest.approx(y, abs=1e-5) for v, y in zip(ids, x / np.linalg.norm(x))}
    e = {r.id: r.eigenvector for r in metrics.eigenvector(g).collect()}
    w = np.abs(np.linalg.eigh((u > 0).astype(float))[1][:, -1])
    assert e == {v: pytest.approx(y, abs=1e-4) for v, y in zip(ids, w)}
    p = np.full(3, 1 / 3)
    t = a / a.sum(1, keepdims=True)
    for _ in range(500):
        p = 0.85 * t.T @ p + 0.05
    assert {r.id: r.pagerank for r in metrics.pagerank(g).collect()} == {v: pytest.approx(y, abs=1e-5) for v, y in zip(ids, p)}
    assert math.isclose(sum(p), 1)
