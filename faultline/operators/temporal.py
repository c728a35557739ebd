"""Graphs through time: windows by row count, evolution, breaks, online correlation.

Windows are numbered by ``snap_id``; all windows of a series are computed in one grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, in_blocks, with_ordinals
from ..plans.iterate import cut
from ..sources.returns import clean, listwise, pairs
from .dependency import correlation


def row_times(returns: DataFrame) -> DataFrame:
    """``t, asset, r, ts`` with t the place of the time stamp among all, from 0."""
    times = with_ordinals(returns.select(F.col("t").alias("ts")).distinct(), "ts", name="t")
    return cut(returns.withColumnRenamed("t", "ts").join(times, "ts").select("t", "asset", "r", "ts"))


def _snapshots(rows: DataFrame, threshold: float, min_obs: int, builder: Callable | None) -> DataFrame:
    """Edges of every window: ``snap_id, a, b, weight``; listwise deletion within a window."""
    whole = listwise(clean(rows), "snap_id")
    enough = whole.groupBy("snap_id").agg(F.countDistinct("t").alias("n")).where(F.col("n") >= min_obs).select("snap_id")
    whole = whole.join(enough, "snap_id", "left_semi")
    if builder is not None:
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            e = builder(pdf.pivot(index="t", columns="asset", values="r").sort_index(), threshold)
            return e.assign(snap_id=key[0])[["snap_id", "a", "b", "weight"]]

        return whole.groupBy("snap_id").applyInPandas(run, "snap_id long, a string, b string, weight double")
    r = pairs(whole, False, "snap_id").groupBy("snap_id", "a", "b").agg(correlation("x", "y").alias("r"))
    return r.where("r is not null and not isnan(r)").where(F.abs("r") >= threshold).select("snap_id", "a", "b", F.bround("r", 6).alias("weight"))


def sliding_snapshots(returns: DataFrame, window: int = 60, step: int = 5, threshold: float = 0.3, min_obs: int = 30, builder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """``(snap_id, window_start, window_end)`` and edges of windows of ``window`` rows every ``step`` rows.

    ``builder(wide frame, threshold)`` may replace correlation; it returns a frame ``a, b, weight``.
    """
    rows = row_times(returns)
    last = (rows.agg(F.max("t")).first()[0] or -1) + 1 - window
    lo = F.greatest(F.lit(0), F.ceil((F.col("t") - window + 1) / step)).cast("long")
    hi = F.least(F.floor(F.col("t") / step), F.lit(last // step)).cast("long")
    spread = rows.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("snap_id", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    spread = cut(spread)
    return _spans(spread), _snapshots(spread, threshold, min_obs, builder)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("snap_id").agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))


def expanding_snapshots(returns: DataFrame, min_window: int = 60, step: int = 10, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Windows from the start to ``min_window``, ``min_window + step``, ... rows."""
    rows = row_times(returns)
    total = (rows.agg(F.max("t")).first()[0] or -1) + 1
    last = (total - min_window) // step if total >= min_window else -1
    first = F.greatest(F.lit(0), F.ceil((F.col("t") + 1 - min_window) / step)).cast("long")
    spread = cut(rows.withColumn("lo", first).where(F.col("lo") <= last).withColumn("snap_id", F.explode(F.sequence(F.col("lo"), F.lit(last).cast("long")))).drop("lo"))
    return _spans(spread), _snapshots(spread, threshold, min_window, None)


def evolution(snaps: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Per snapshot: edges, density, mean weight, mean clustering, components and turnover against the one before.

    ``assets``: ``snap_id, id``, the vertices of each snapshot.
    """
    edges = cut(edges)
    n = assets.groupBy("snap_id").agg(F.count(F.lit(1)).alias("n"))
    basic = edges.groupBy("snap_id").agg(F.count(F.lit(1)).alias("m"), F.avg("weight").alias("w"))
    # All snapshots at once: vertices and edges carry the snapshot in their names.
    tag = lambda c: F.concat_ws("\u0001", F.col("snap_id").cast("string"), F.col(c))
    g = Graph(assets.select(tag("id").alias("id")), edges.select(tag("a").alias("src"), tag("b").alias("dst"), "weight"), False)
    from .metrics import clustering
    from .paths import components

    snap = F.split("id", "\u0001")[0].cast("long").alias("snap_id")
    clus = clustering(g).groupBy(snap).agg(F.avg("clustering").alias("avg_clustering"))
    comp = components(g).groupBy(snap).agg(F.countDistinct("component").alias("n_components"))
    cur = edges.select(F.col("snap_id").alias("s"), "a", "b")
    kept = cur.alias("x").join(cur.alias("y"), F.expr("x.s = y.s + 1 and x.a = y.a and x.b = y.b")).groupBy(F.col("x.s").alias("snap_id")).agg(F.count(F.lit(1)).alias("kept"))
    out = snaps.join(n, "snap_id", "left").join(basic, "snap_id", "left").join(clus, "snap_id", "left").join(comp, "snap_id", "left").join(kept, "snap_id", "left")
    m = F.coalesce("m", F.lit(0))
    before = F.lag(m).over(Window.orderBy("snap_id"))
    change = (m - F.coalesce("kept", F.lit(0))) + (before - F.coalesce("kept", F.lit(0)))
    turnover = F.when(before.isNotNull() & ((m > 0) | (before > 0)), change / (m + before + 1e-9))
    possible = F.col("n") * (F.col("n") - 1) / 2
    return out.select(F.col("window_end").alias("ts"), m.alias("n_edges"), F.when(possible > 0, m / possible).otherwise(0.0).alias("density"), F.coalesce("w", F.lit(0.0)).alias("avg_weight"), F.coalesce("avg_clustering", F.lit(0.0)).alias("avg_clustering"), F.coalesce("n_components", F.lit(0)).alias("n_components"), turnover.alias("edge_turnover"))


def z_scores(series: DataFrame, column: str, window: int = 10, least: int = 3) -> DataFrame:
    """``ts, value, z`` against the mean and sample deviation of the last ``window`` rows, this one included."""
    s = series.where(F.col(column).isNotNull()).select("ts", F.col(column).cast("double").alias("value"))
    s = in_blocks(with_ordinals(s, "ts"), window - 1)
    w = Window.partitionBy("block").orderBy("ord").rowsBetween(1 - window, 0)
    z = (F.col("value") - F.avg("value").over(w)) / (F.stddev_samp("value").over(w) + 1e-9)
    s = s.withColumn("z", F.when(F.count("value").over(w) >= least, z))
    return s.where("not halo").select("ts", "value", "z")


def structural_breaks(series: DataFrame, column: str = "density", z_threshold: float = 2.5) -> DataFrame:
    return z_scores(series, column).where(F.abs("z") > z_threshold)


METRICS = ("n_edges", "density", "avg_weight", "avg_clustering", "n_components", "edge_turnover")


def anomaly_flags(series: DataFrame, metric: str = "density", window: int = 10, z_threshold: float = 2.0) -> DataFrame:
    if metric not in series.columns:
        raise ValueError(f"Unknown metric: {metric}")
    return z_scores(series, metric, window).select("ts", "z", F.coalesce(F.abs("z") > z_threshold, F.lit(False)).alias("flag"))


def temporal_centrality(edges: DataFrame, assets: DataFrame, centrality: str = "betweenness") -> DataFrame:
    """``snap_id, id, value``: degree, closeness, eigenvector or betweenness within each snapshot; 0 where absent."""
    import numpy as np

    from ..functions import kernels

    if centrality == "degree":
        d = edges.select("snap_id", F.explode(F.array("a", "b")).alias("id")).groupBy("snap_id", "id").agg(F.count(F.lit(1)).alias("d"))
        n = assets.groupBy("snap_id").agg(F.count(F.lit(1)).alias("n"))
        return assets.join(d, ["snap_id", "id"], "left").na.fill(0).join(n, "snap_id").select("snap_id", "id", (F.col("d") / (F.col("n") - 1)).alias("value"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf.b.isna(), "a"])
        e = pdf[pdf.b.notna()]
        adj: dict = {}
        for a, b in zip(e.a, e.b):
            adj.setdefault(a, []).append((b, 1.0))
            adj.setdefault(b, []).append((a, 1.0))
        n, value = len(ids), dict.fromkeys(ids, 0.0)
        if centrality == "closeness":
            for v in ids:
                d = list(kernels.distances(v, adj).values())
                if sum(d):
                    value[v] = (len(d) - 1) / sum(d) * (len(d) - 1) / (n - 1)
        elif centrality == "eigenvector":
            x = np.full(n, 1 / n)
            at = {v: i for i, v in enumerate(ids)}
            s, t = np.array([at[v] for v in e.a], dtype=int), np.array([at[v] for v in e.b], dtype=int)
            for _ in range(500):
                y = x + np.bincount(s, x[t], n) + np.bincount(t, x[s], n)
                y /= np.linalg.norm(y) or 1
                moved, x = np.abs(y - x).sum(), y
                if moved < n * 1e-6:
                    value = dict(zip(ids, x))
                    break
        elif n > 2:
            for v in ids:
                for u, s in kernels.dependencies(v, adj).items():
                    value[u] += s / ((n - 1) * (n - 2))
        return pd.DataFrame([(key[0], v, float(value[v])) for v in ids], columns=["snap_id", "id", "value"])

    rows = edges.select("snap_id", "a", "b").unionByName(assets.select("snap_id", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")))
    return rows.groupBy("snap_id").applyInPandas(run, "snap_id long, id string, value double")


def wide(values: DataFrame) -> DataFrame:
    """One column a vertex, one row a snapshot, gaps at 0."""
    return values.groupBy("snap_id").pivot("id").agg(F.first("value")).na.fill(0.0)


def ewm_correlations(returns: DataFrame, alpha: float = 0.06, start_variance: float = 0.01) -> DataFrame:
    """``a, b, corr`` after the last observation of exponentially weighted moments, pair by pair in the JVM.

    The first observation sets the means only; deviations are from the means before the update.
    """
    p = pairs(clean(returns)).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("o"))
    zero = F.struct(F.get("o", F.lit(0))["x"].alias("mx"), F.get("o", F.lit(0))["y"].alias("my"), F.lit(start_variance).alias("xx"), F.lit(start_variance).alias("yy"), F.lit(0.0).alias("xy"))

    def step(s, o):
        dx, dy = o["x"] - s["mx"], o["y"] - s["my"]
        keep = 1 - alpha
        return F.struct((keep * s["mx"] + alpha * o["x"]).alias("mx"), (keep * s["my"] + alpha * o["y"]).alias("my"), (keep * s["xx"] + alpha * dx * dx).alias("xx"), (keep * s["yy"] + alpha * dy * dy).alias("yy"), (keep * s["xy"] + alpha * dx * dy).alias("xy"))

    end = p.select("a", "b", F.aggregate(F.slice("o", F.lit(2), F.size("o")), zero, step).alias("s"))
    corr = F.col("s.xy") / ((F.sqrt("s.xx") + 1e-9) * (F.sqrt("s.yy") + 1e-9))
    return end.select("a", "b", corr.alias("corr"))


def ewm_graph(returns: DataFrame, alpha: float = 0.06, threshold: float = 0.3) -> DataFrame:
    return ewm_correlations(returns, alpha).where(F.abs("corr") >= threshold).select("a", "b", F.bround("corr", 6).alias("weight"))
