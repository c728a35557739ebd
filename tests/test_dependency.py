import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import dependency, multilayer, temporal
from faultline.sources import returns as R
from faultline.streaming import online


def series(spark, columns):
    rows = [(t, name, float(v)) for name, values in columns.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "t long, asset string, r double")


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(5)
    x = rng.normal(size=120)
    return {"a": x, "b": x + 0.5 * rng.normal(size=120), "c": rng.normal(size=120)}


def test_correlations_match_numpy(spark, panel):
    got = {(r.a, r.b): r.weight for r in dependency.pearson_graph(series(spark, panel), 0.0, None, 30).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef(panel["a"], panel["b"])[0, 1], abs=1e-6)
    strict = dependency.pearson_graph(series(spark, panel), 0.3, 0.05, 30).collect()
    assert [(r.a, r.b) for r in strict] == [("a", "b")]


def test_missing_values_are_deleted_by_pair(spark, panel):
    p = {k: v.copy() for k, v in panel.items()}
    p["b"][:100] = np.nan
    got = dependency.pearson_graph(series(spark, p), 0.0, None, 30)
    assert {(r.a, r.b) for r in got.collect()} == {("a", "c")}


def test_distance(spark):
    row = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "weight double").select(dependency.distance().alias("d")).collect()
    assert [r.d for r in row] == [0.0, 2.0, pytest.approx(1.414214)]


def test_transfer_entropy_and_information(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=600)
    lead = {"x": x, "y": np.concatenate(([0.0], x[:-1])) + 0.01 * rng.normal(size=600)}
    te = {(r.src, r.dst): r.te for r in dependency.transfer_entropy_graph(series(spark, lead), 0.0).collect()}
    assert te[("x", "y")] > 2 * te[("y", "x")]
    g = {(r.src, r.dst) for r in dependency.granger_graph(series(spark, lead), 3).collect()}
    assert ("x", "y") in g


def test_adjustment_is_monotone_on_request(spark):
    df = spark.createDataFrame([(0.01,), (0.011,), (0.5,)], "p_value double")
    plain = [r.p_adj for r in dependency.bh_adjust(df).orderBy("p_value").collect()]
    assert plain == pytest.approx([0.03, 0.0165, 0.5])
    assert [r.p_adj for r in dependency.bh_adjust(df, monotone=True).orderBy("p_value").collect()] == pytest.approx([0.0165, 0.0165, 0.5])


def test_fusion_and_similarity(spark):
    layers = spark.createDataFrame([("l", False, "a", "b", 2.0), ("l", False, "b", "c", 1.0), ("m", True, "b", "a", 4.0)], multilayer.LAYERS)
    m = multilayer.Multiplex.of(layers)
    fused = {(r.a, r.b): r.weight for r in multilayer.fuse_weighted(m).collect()}
    assert fused == {("a", "b"): 1.0, ("b", "c"): 0.25}
    assert [(r.a, r.b, r.layer_count, r.weight) for r in multilayer.fuse_intersection(m, 2).collect()] == [("a", "b", 2, 3.0)]
    j = {(r.l1, r.l2): r.jaccard for r in multilayer.layer_jaccard(m).collect()}
    assert j[("l", "l")] == 1.0 and j[("l", "m")] == j[("m", "l")] == 0.5
    lap = multilayer.supra_laplacian(m).groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in lap)
    assert m.remove_layer("m").vertices.count() == 3


def test_windows(spark, panel):
    s = series(spark, panel)
    snaps, edges = temporal.sliding_snapshots(s, 60, 20, 0.0, 30)
    assert snaps.count() == 4
    first = edges.where("snap_id = 1 and a = 'a' and b = 'b'").first()
    assert first.weight == pytest.approx(np.corrcoef(panel["a"][20:80], panel["b"][20:80])[0, 1], abs=1e-6)
    snaps, edges = temporal.expanding_snapshots(s, 60, 30, 0.0)
    assert snaps.count() == 3
    assert edges.where("snap_id = 2 and a = 'a' and b = 'b'").first().weight == pytest.approx(np.corrcoef(panel["a"], panel["b"])[0, 1], abs=1e-6)


def test_online_state_equals_the_batch_form(spark, panel):
    s = series(spark, panel)
    batch = {(r.a, r.b): r["corr"] for r in temporal.ewm_correlations(s).collect()}
    state = None
    for t in range(120):
        state = online.update(state, t, panel["a"][t], panel["b"][t], 0.06)
    assert state[6] / ((state[4] ** 0.5 + 1e-9) * (state[5] ** 0.5 + 1e-9)) == pytest.approx(batch[("a", "b")])


def test_stream_of_pairs(spark, panel, tmp_path):
    pairs = R.pairs(series(spark, panel)).select("a", "b", "t", "x", "y")
    pairs.where("t < 60").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    pairs.where("t >= 60").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = online.online_correlations(stream).writeStream.format("memory").queryName("ewm").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {(r.a, r.b): r for r in spark.table("ewm").orderBy("n").collect()}
    batch = {(r.a, r.b): r["corr"] for r in temporal.ewm_correlations(series(spark, panel)).collect()}
    assert last[("a", "b")].n == 120 and last[("a", "b")]["corr"] == pytest.approx(batch[("a", "b")])


def test_breaks_need_three_values(spark):
    df = spark.createDataFrame([(i, 1.0 if i != 15 else 50.0) for i in range(20)], "ts int, density double")
    assert [r.ts for r in temporal.structural_breaks(df).collect()] == [15]
    with pytest.raises(ValueError):
        temporal.anomaly_flags(df, "nope")
