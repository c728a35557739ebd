import pytest
from pyspark.sql import functions as F

from faultline.graph import Graph, with_ordinals
from faultline.operators import contagion, metrics, paths, structure
from faultline.sources import network


def graph(spark, edges, directed=True, vertices=None):
    e = spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in edges], "src string, dst string, weight double")
    v = spark.createDataFrame([(str(x),) for x in vertices], "id string") if vertices else None
    return Graph.from_edges(e, directed, v)


def as_dict(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_loader_sums_and_defaults(spark, tmp_path):
    (tmp_path / "x.csv").write_text("source,target,exposure\na,b,1.5\na,b,2\na,c,oops\nb,c,NaN\n,c,4\nb,a,\n")
    e = {(r.src, r.dst): r.exposure for r in network.sum_edges(network.read_csv(spark, str(tmp_path / "x.csv"))).collect()}
    assert e == {("a", "b"): 3.5, ("a", "c"): 1.0, ("b", "c"): 1.0, ("b", "a"): 1.0}
    counted = network.sum_edges(network.read_csv(spark, str(tmp_path / "x.csv")), weighted=False)
    assert {(r.src, r.dst): r.exposure for r in counted.collect()}[("a", "b")] == 2.0
    assert network.rejected_ends(network.read_csv(spark, str(tmp_path / "x.csv"))).first()[0] == 1
    (tmp_path / "y.csv").write_text("source,exposure\na,1\n")
    with pytest.raises(ValueError, match="target"):
        network.load_network(spark, str(tmp_path / "y.csv"))


def test_capital_is_bounded_and_repeatable(spark):
    g = network.synthetic_network(spark, 30, 0.2)
    out = network.out_exposure(g.vertices, g.edges.withColumnRenamed("weight", "exposure"))
    rows = g.vertices.join(out, "id").collect()
    assert len(rows) == 30 and all(0.1 * (r.out + 10) - 0.01 <= r.capital <= 0.3 * (r.out + 10) + 0.01 for r in rows)
    assert sorted(g.vertices.collect()) == sorted(network.synthetic_network(spark, 30, 0.2).vertices.collect())


def test_ordinals_are_ranks(spark):
    df = with_ordinals(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), "id")
    assert [r.ord for r in df.orderBy("id").collect()] == list(range(1000))


def test_undirected_takes_the_later_source(spark):
    u = graph(spark, [("a", "b", 1), ("b", "a", 5)]).undirected()
    assert [(r.src, r.dst, r.weight) for r in u.edges.collect()] == [("a", "b", 5.0)]


def test_threshold_contagion_on_a_chain(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("b", "x", 1), ("c", "d", 1)])
    seeds = spark.createDataFrame([("d",)], "id string")
    steps = {r.id: r.step for r in contagion.threshold_contagion(g, seeds, 0.5).collect()}
    assert steps == {"d": 0, "c": 1, "b": 2, "a": 3}
    assert {r.id for r in contagion.threshold_contagion(g, seeds, 0.6).collect()} == {"d", "c"}
    assert contagion.threshold_contagion(g, seeds.limit(0), 0.5).count() == 0


def test_cascade_fails_at_capital(spark):
    g = graph(spark, [("a", "b", 3), ("c", "b", 1)])
    g = Graph(spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0)], "id string, capital double"), g.edges)
    failed, loss = contagion.balance_sheet_cascade(g, spark.createDataFrame([("b",)], "id string"))
    assert {r.id: r.step for r in failed.collect()} == {"b": 0, "a": 1}
    assert {r.id: r.loss for r in loss.collect()} == {"a": 3.0, "c": 1.0}


def test_attack_flags():
    assert contagion.parse_attack(" Degree:5 ") == ("degree", 5)
    assert contagion.parse_attack("random") == ("random", None)
    assert contagion.parse_attack("degree:x") == ("degree", None)


def test_triangle_with_tail(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)], False)
    c = {r.id: r.clustering for r in metrics.clustering(g).collect()}
    assert c == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0}
    assert metrics.transitivity(g).first()[0] == pytest.approx(3 / 5)
    assert {r.id: r.coreness for r in metrics.coreness(g).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1}
    b = {r.id: r.betweenness for r in paths.betweenness(g).collect()}
    assert b["c"] == pytest.approx(2 / 3) and b["a"] == 0.0


def test_components_and_paths(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 1), ("x", "y", 1)], False)
    assert {r.id: r.component for r in paths.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    row = paths.path_lengths(g).first()
    assert (row.n_components, row.diameter) == (2, 2) and row.avg_path_length == pytest.approx(4 / 3)


def test_a_long_path_is_one_component(spark):
    g = graph(spark, [(f"{i:03d}", f"{i + 1:03d}", 1) for i in range(60)], False)
    assert paths.components(g).select("component").distinct().count() == 1


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_in_one_task_and_in_rounds(spark, small):
    import random

    from faultline.plans.iterate import least_reachable

    rng = random.Random(4)
    path = list(range(700, 1100))
    rng.shuffle(path)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 650)] + list(zip(path, path[1:])) + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = least_reachable(spark.createDataFrame(edges, "a long, b long"), small=small).collect()
    assert {r.v: r.label for r in got} == want and len(got) == len(want)


def test_pagerank_sums_to_one(spark):
    g = graph(spark, [("a", "b", 1), ("b", "a", 1), ("c", "a", 2)], True, ["a", "b", "c", "d"])
    assert metrics.pagerank(g).agg(F.sum("pagerank")).first()[0] == pytest.approx(1.0)


def test_spanning_forest_and_curve(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 3.0), ("x", "y", 1.0)], "src string, dst string, distance double")
    assert {(r.src, r.dst) for r in structure.spanning_forest(e).collect()} == {("a", "b"), ("b", "c"), ("x", "y")}
    g = graph(spark, [("c", x, 1) for x in "abde"], False)
    curve = structure.attack_curve(g, structure.attack_order(g, "degree")).orderBy("fraction_removed").collect()
    assert [r.lcc for r in curve] == [0.2, 0.2, 0.2, 0.2, 0.0] and curve[0].edges == 0
