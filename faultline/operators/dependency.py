"""Dependency graphs from return series: correlation, causality and information.

``returns`` is long: ``t, asset, r`` without nulls (``sources.returns.clean``). Pairs come from one join
on time; per-pair statistics are aggregates in the JVM, or a numpy kernel per pair where none exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import kernels, stats
from ..graph import Graph, with_ordinals
from ..plans.iterate import cut
from ..sources.returns import clean, listwise, pairs


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([stats.correlation_p(float(a), int(b)) if a == a else float("nan") for a, b in zip(r, n)])


def _keep(corr: DataFrame, threshold: float, p_cutoff: float | None, min_periods: int) -> DataFrame:
    """Edges of enough, strong and significant correlations.

    The p cut-off is a least |r| for each number of observations (there are few), so the filter runs in
    the JVM; p itself is computed for the edges that stay.
    """
    kept = corr.where(f"n_obs >= {int(min_periods)} and r is not null and not isnan(r)").where(F.abs("r") >= threshold)
    if p_cutoff is not None:
        kept = cut(kept)
        sizes = [row[0] for row in kept.select("n_obs").distinct().collect()]  # no more than there are times
        least = kept.sparkSession.createDataFrame([(n, stats.critical_correlation(n, p_cutoff)) for n in sizes], "n_obs long, __least double")
        kept = kept.join(F.broadcast(least), "n_obs").where(F.abs("r") >= F.col("__least")).drop("__least")
    kept = kept.withColumn("p", correlation_p("r", "n_obs"))
    return kept.select("a", "b", F.bround("r", 6).alias("weight"), F.bround("p", 6).alias("p_value"), "n_obs")


def correlations(returns: DataFrame, *group: str) -> DataFrame:
    """``a, b, r, n_obs`` of every pair with a time in common."""
    return pairs(returns, False, *group).groupBy(*group, "a", "b").agg(correlation("x", "y").alias("r"), F.count(F.lit(1)).alias("n_obs"))


def pearson_graph(returns: DataFrame, threshold: float = 0.3, p_cutoff: float | None = 0.05, min_periods: int = 30) -> DataFrame:
    return _keep(correlations(clean(returns)), threshold, p_cutoff, min_periods)


def rank_correlations(returns: DataFrame) -> DataFrame:
    """Pearson of average ranks, ranked anew within each pair's common times."""
    p = pairs(returns)
    for side in ("x", "y"):
        low = F.rank().over(Window.partitionBy("a", "b").orderBy(side))
        ties = F.count(F.lit(1)).over(Window.partitionBy("a", "b", side))
        p = p.withColumn(f"r{side}", low + (ties - 1) / 2)
    return p.groupBy("a", "b").agg(correlation("rx", "ry").alias("r"), F.count(F.lit(1)).alias("n_obs"))


def spearman_graph(returns: DataFrame, threshold: float = 0.3, p_cutoff: float | None = 0.05, min_periods: int = 30) -> DataFrame:
    return _keep(rank_correlations(clean(returns)), threshold, p_cutoff, min_periods)


def _panel(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot(index="t", columns="asset", values="r").sort_index().dropna()


def _dense(returns: DataFrame, function, schema: str) -> DataFrame:
    """A kernel on the whole panel, after checking that it is small enough."""
    told = returns.agg(F.countDistinct("asset").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if told.n > kernels.MAX_DENSE or told.rows > kernels.MAX_CELLS:
        raise ValueError(f"more than {kernels.MAX_DENSE} assets or {kernels.MAX_CELLS} observations in a dense matrix")
    names = [c.split()[0] for c in schema.split(", ")]
    return returns.groupBy(F.lit(0).alias("k")).applyInPandas(lambda pdf: pd.DataFrame(function(_panel(pdf)), columns=names), schema)


def partial_correlation_graph(returns: DataFrame, threshold: float = 0.15, method: str = "glasso") -> DataFrame:
    """``a, b, weight`` from a sparse (glasso) or shrunk precision matrix; Pearson's graph if that fails."""

    def run(panel: pd.DataFrame) -> list[tuple]:
        x = panel.to_numpy()
        try:
            p = stats.graphical_lasso_cv(x - x.mean(0)) if method == "glasso" else np.linalg.inv(stats.ledoit_wolf(x))
        except np.linalg.LinAlgError:
            return [(None, None, None, True)]
        d = np.sqrt(np.diag(p))
        names = list(panel.columns)
        rho = -p / np.outer(d, d)
        if not np.isfinite(rho).all():
            return [(None, None, None, True)]
        pairs_ = [(names[i], names[j], float(rho[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
        return [(min(a, b), max(a, b), round(r, 6), False) for a, b, r in pairs_ if abs(r) >= threshold]

    whole = listwise(clean(returns))
    found = cut(_dense(whole, run, "a string, b string, weight double, failed boolean"))
    if not found.where("failed").isEmpty():
        return pearson_graph(returns, threshold).select("a", "b", "weight")
    return found.where("not failed").select("a", "b", "weight")


def spectral_graph_learning(returns: DataFrame, beta: float = 0.1) -> DataFrame:
    """``a, b, weight``: soft-thresholded absolute precision; its Laplacian by ``laplacian``."""

    def run(panel: pd.DataFrame) -> list[tuple]:
        p = np.abs(np.linalg.inv(stats.ledoit_wolf(panel.to_numpy())))
        names = list(panel.columns)
        return [(min(names[i], names[j]), max(names[i], names[j]), float(p[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]

    w = _dense(listwise(clean(returns)), run, "a string, b string, p double")
    return w.withColumn("weight", F.col("p") - beta).where("weight > 0").select("a", "b", F.bround("weight", 6).alias("weight"))


def laplacian(edges: DataFrame) -> DataFrame:
    """``a, b, v``: degrees on the diagonal, negative weights off it."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.select("a", "b", (-F.col("weight")).alias("v")).unionByName(both.groupBy("a").agg(F.sum("weight").alias("v")).select("a", F.col("a").alias("b"), "v"))


def distance(weight: Column | str = "weight") -> Column:
    """Mantegna's distance of a correlation; a missing one counts 0."""
    w = F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0.0))
    return F.bround(F.sqrt(2 * (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w)))), 6)


def with_distance(edges: DataFrame) -> DataFrame:
    return edges.withColumn("distance", distance())


def as_graph(edges: DataFrame, returns: DataFrame | None = None, directed: bool = False) -> Graph:
    """An ``a, b`` edge list as a graph on all assets."""
    e = edges.withColumnsRenamed({"a": "src", "b": "dst"} if "a" in edges.columns else {})
    v = returns.select(F.col("asset").alias("id")).distinct() if returns is not None else None
    return Graph.from_edges(e, directed, v)


def correlation_suite(returns: DataFrame, threshold: float = 0.3) -> dict[str, DataFrame]:
    """The six correlation layers as ``a, b, weight``."""
    from .structure import planar_filter, spanning_forest

    returns = cut(clean(returns))
    pearson = cut(with_distance(pearson_graph(returns, threshold)))
    g = as_graph(pearson, returns)
    tree = spanning_forest(g.edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    flat = planar_filter(g).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return {
        "pearson": pearson.select("a", "b", "weight"),
        "spearman": spearman_graph(returns, threshold).select("a", "b", "weight"),
        "partial": partial_correlation_graph(returns, threshold * 0.5),
        "mst": tree,
        "pmfg": pearson.join(flat, ["a", "b"], "left_semi").select("a", "b", "weight"),
        "spectral": spectral_graph_learning(returns),
    }


# --- causality --------------------------------------------------------------------------------

def bh_adjust(tests: DataFrame, p: str = "p_value", monotone: bool = False) -> DataFrame:
    """p * m / rank, capped at 1; ``monotone`` adds the step-up minimum.

    Ranks are places among range partitions, the minimum runs over blocks of ranks and then inside them.
    """
    placed = cut(with_ordinals(tests, p))
    m = placed.count()
    adj = placed.withColumn("p_adj", F.least(F.lit(1.0), F.col(p) * m / (F.col("ord") + 1)))
    if not monotone:
        return adj.drop("ord")
    adj = adj.withColumn("__block", F.floor(F.col("ord") / 20_000))
    after = F.min("least").over(Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1))
    blocks = adj.groupBy("__block").agg(F.min("p_adj").alias("least")).select("__block", after.alias("__after"))  # one row in 20,000
    inside = F.min("p_adj").over(Window.partitionBy("__block").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return adj.withColumn("__inside", inside).join(blocks, "__block").withColumn("p_adj", F.least("__inside", "__after")).drop("ord", "__block", "__inside", "__after")


def granger_tests(returns: DataFrame, max_lag: int = 5, stationarize: bool = True, min_periods: int = 60, compat_direction: bool = False) -> DataFrame:
    """``src, dst, f_stat, p_value, lag`` of every ordered pair: whether the past of src improves dst.

    ``compat_direction`` tests the reverse of what an edge says, as some published code does.
    """
    returns = clean(returns)
    if stationarize:
        def difference(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            y = stats.stationary(pdf["r"].to_numpy())
            return pd.DataFrame({"t": pdf["t"].iloc[len(pdf) - len(y) :], "asset": pdf["asset"].iloc[0], "r": y})

        kind = dict(returns.dtypes)["t"]
        returns = cut(returns.select("t", "asset", "r").groupBy("asset").applyInPandas(difference, f"t {kind}, asset string, r double"))

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        if len(x) < min_periods:
            return pd.DataFrame(columns=["src", "dst", "f_stat", "p_value", "lag"])
        lag = stats.lag_order(x, y, max_lag)
        f, p = stats.granger(y, x, lag) if compat_direction else stats.granger(x, y, lag)
        return pd.DataFrame([(key[0], key[1], f, p, lag)], columns=["src", "dst", "f_stat", "p_value", "lag"]).dropna()

    return pairs(returns, True).groupBy("a", "b").applyInPandas(test, "src string, dst string, f_stat double, p_value double, lag int")


def granger_graph(returns: DataFrame, max_lag: int = 5, alpha: float = 0.05, fdr: bool = True, stationarize: bool = True, min_periods: int = 60, compat_direction: bool = False) -> DataFrame:
    tests = granger_tests(returns, max_lag, stationarize, min_periods, compat_direction)
    tests = bh_adjust(tests) if fdr else tests.withColumn("p_adj", F.col("p_value"))
    return tests.where(F.col("p_adj") <= alpha).select("src", "dst", F.bround("f_stat", 6).alias("weight"), F.bround("p_adj", 6).alias("p_value"), "lag")


def mutual_information_knn(returns: DataFrame, threshold: float = 0.1, min_periods: int = 60, k: int = 5) -> DataFrame:
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        return pd.DataFrame([(key[0], key[1], stats.ksg(x, y, k))] if len(x) >= min_periods else [], columns=["a", "b", "mi"])

    mi = pairs(listwise(clean(returns))).groupBy("a", "b").applyInPandas(run, "a string, b string, mi double")
    return mi.where(F.col("mi") >= threshold).select("a", "b", F.bround("mi", 6).alias("mi"))


def mutual_information_histogram(returns: DataFrame, threshold: float = 0.1, bins: int = 10, min_periods: int = 60) -> DataFrame:
    """Plug-in estimate in nats on equal-width bins of each series' range."""
    r = listwise(clean(returns))
    w = Window.partitionBy("asset")
    lo, hi = F.min("r").over(w), F.max("r").over(w)
    cell = F.when(hi > lo, F.least(F.floor((F.col("r") - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    p = pairs(r.withColumn("r", cell.cast("int")))
    joint = p.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    pair = Window.partitionBy("a", "b")
    joint = joint.withColumn("n", F.sum("c").over(pair)).withColumn("cx", F.sum("c").over(Window.partitionBy("a", "b", "x"))).withColumn("cy", F.sum("c").over(Window.partitionBy("a", "b", "y")))
    mi = joint.groupBy("a", "b").agg(F.first("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))
    return mi.where(F.col("n") >= min_periods).withColumn("mi", F.greatest(F.col("mi"), F.lit(0.0))).where(F.col("mi") >= threshold).select("a", "b", F.bround("mi", 6).alias("mi"))


def ordinal_symbols(returns: DataFrame, order: int = 3) -> DataFrame:
    """``t, asset, sym``: the comparisons of ``order`` consecutive values, which tell their argsort."""
    w = Window.partitionBy("asset").orderBy("t")
    v = returns
    for k in range(order):
        v = v.withColumn(f"x{k}", F.lead("r", k).over(w))
    bits = [F.when(F.col(f"x{i}") > F.col(f"x{j}"), "1").otherwise("0") for i in range(order) for j in range(i + 1, order)]
    return v.where(F.col(f"x{order - 1}").isNotNull()).select("t", "asset", F.concat(*bits).alias("sym"))


def transfer_entropy_graph(returns: DataFrame, threshold: float = 0.05, order: int = 3, lag: int = 1, min_periods: int = 100) -> DataFrame:
    """``src, dst, te``: what src's symbol adds to dst's own in telling dst's next."""
    r = listwise(clean(returns))
    s = ordinal_symbols(r, order).withColumn("nxt", F.lead("sym", lag).over(Window.partitionBy("asset").orderBy("t")))
    x = s.select("t", F.col("asset").alias("src"), F.col("sym").alias("xp"))
    y = s.where("nxt is not null").select("t", F.col("asset").alias("dst"), F.col("sym").alias("yp"), F.col("nxt").alias("yf"))
    c = x.join(y, "t").where("src <> dst").groupBy("src", "dst", "yf", "yp", "xp").agg(F.count(F.lit(1)).alias("c"))
    by = lambda *k: Window.partitionBy("src", "dst", *k)
    c = c.withColumn("n", F.sum("c").over(by())).withColumn("c_yp", F.sum("c").over(by("yp"))).withColumn("c_yfyp", F.sum("c").over(by("yf", "yp"))).withColumn("c_ypxp", F.sum("c").over(by("yp", "xp")))
    te = c.groupBy("src", "dst").agg(F.first("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("c_yp") / (F.col("c_yfyp") * F.col("c_ypxp")))).alias("te"))
    enough = F.col("n") + (order - 1) + lag >= min_periods
    return te.where(enough & (F.col("n") >= 10)).withColumn("te", F.greatest("te", F.lit(0.0))).where(F.col("te") >= threshold).select("src", "dst", F.bround("te", 6).alias("te"))


def causality_suite(returns: DataFrame, granger_alpha: float = 0.05, mi_threshold: float = 0.1, te_threshold: float = 0.05) -> dict[str, DataFrame]:
    """The three causality layers as ``a, b, weight``."""
    return {
        "granger": granger_graph(returns, alpha=granger_alpha).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"),
        "mutual_info": mutual_information_knn(returns, mi_threshold).select("a", "b", F.col("mi").alias("weight")),
        "transfer_entropy": transfer_entropy_graph(returns, te_threshold).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("te").alias("weight")),
    }
