"""The views that the registered queries stand on keep every row of their tables."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from faultline.graph import Graph, in_blocks, with_ordinals
from faultline.plans import queries
from faultline.sources import tables


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    rng = random.Random(1)
    day = lambda k: datetime.datetime(2000, 1, 1 + k, rng.randrange(24))
    rows = [(o, o % 4, rng.randrange(3), rng.randrange(12), 100.25 * (1 + rng.randrange(50)), 0.1, day(rng.randrange(3))) for o in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(s, s % 3) for s in range(12)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    return d, rows


def test_deliveries_link_consecutive_lines(spark, lines):
    d, rows = lines
    groups = collections.defaultdict(list)
    for o, n, p, s, v, _, t in rows:
        groups[p, t.date()].append((o, n, s, v))
    want = collections.Counter()
    for g in groups.values():
        g.sort()
        for (_, _, a, _), (_, _, b, v) in zip(g, g[1:]):
            if a != b:
                want[f"{a:08d}", f"{b:08d}"] += v
    got = {(r.src, r.dst): r.exposure for r in tables.deliveries(spark, d).collect()}
    assert got == {k: pytest.approx(v / 1e4, abs=1e-6) for k, v in want.items()}


def test_queries_see_every_link(spark, lines):
    d, _ = lines
    e = {(r.src, r.dst) for r in tables.deliveries(spark, d).collect()}
    got = {r.id: (r.in_degree, r.out_degree) for r in queries.queries()["degree_metrics"](spark, d).collect()}
    ids = {x for p in e for x in p}
    assert got == {v: (sum(b == v for _, b in e), sum(a == v for a, _ in e)) for v in ids}


@pytest.mark.parametrize("back", [1, 3])
def test_blocks_look_back_over_their_edge(spark, back):
    from pyspark.sql import Window

    df = in_blocks(with_ordinals(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), "v"), back, 50)
    w = Window.partitionBy("block").orderBy("ord")
    rows = df.withColumn("b", F.lag("v", back).over(w)).where("not halo").collect()
    assert sorted((r.v, r.b) for r in rows if r.v >= back) == [(v, v - back) for v in range(back, 1000)] and len(rows) == 1000


def test_events_of_a_type_follow_each_other(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=rng.randrange(200)), rng.randrange(6), rng.choice("ab")) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = collections.Counter()
    for kind in "ab":
        own = sorted((t, i, u) for i, t, u, k in rows if k == kind)
        for (_, _, u), (_, _, v) in zip(own, own[1:]):
            if u != v:
                want[kind, f"{min(u, v):08d}", f"{max(u, v):08d}"] += 1
    got = {(r.layer, r.src, r.dst): r.weight for r in tables.event_layers(spark, str(tmp_path)).layers.collect()}
    assert got == want


def test_a_bridge_of_low_degree_is_important(spark, monkeypatch):
    """Two hubs of two triangles each, joined through one vertex of two neighbours, as few as any has."""
    links = [(h, f"{h[0]}{i}") for h in ("l0", "r0") for i in range(1, 5)] + [(f"{s}{i}", f"{s}{i + 1}") for s in "lr" for i in (1, 3)] + [("l0", "x"), ("x", "r0")]
    rows = [(a, b, 1.0) for a, b in links] + [(b, a, 1.0) for a, b in links]
    g = Graph.from_edges(spark.createDataFrame(rows, "src string, dst string, weight double"))
    monkeypatch.setattr(queries, "_directed", lambda *a, **k: queries._cached(g))
    assert [r.id for r in queries.systemic_importance(spark, "").collect()][:3] == ["l0", "r0", "x"]


def test_walks_and_scenarios_have_the_operators_sizes(spark, monkeypatch):
    from faultline.operators import embedding, features

    g = Graph.from_edges(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double"))
    seen = {}
    monkeypatch.setattr(queries, "_undirected", lambda *a, **k: g)
    monkeypatch.setattr(queries, "_directed", lambda *a, **k: g)
    monkeypatch.setattr(queries, "cut", lambda df: df)
    monkeypatch.setattr(features, "train_scenarios", lambda g, s: (None, s, None))
    for module, name in ((embedding, "random_walks"), (embedding, "node2vec"), (features, "shock_scenarios")):
        monkeypatch.setattr(module, name, lambda g, *a, name=name, **k: seen.setdefault(name, (a, k)))
    for query in (queries.random_walks, queries.node2vec, queries.shock_scenarios_lr):
        query(spark, "")
    assert seen == dict.fromkeys(("random_walks", "node2vec", "shock_scenarios"), ((), {}))


def test_event_layers_are_written_apart_from_their_window(spark, tmp_path):
    """A window that asks for memory beside sums that hold all of it ends the task: UNABLE_TO_ACQUIRE_MEMORY."""
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", (k * 7) % 5, "view" if k % 3 else "click") for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    m = tables.event_layers(spark, str(tmp_path))
    plan = m.layers._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    want = collections.Counter()
    for kind in ("click", "view"):
        users = [u for _, _, u, _ in sorted((r for r in rows if r[3] == kind), key=lambda r: (r[1], r[0]))]
        want.update((kind, f"{min(p):08d}", f"{max(p):08d}") for p in zip(users, users[1:]) if p[0] != p[1])
    assert {(r.layer, r.src, r.dst): r.weight for r in m.layers.collect()} == want
