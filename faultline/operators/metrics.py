"""Local and global graph metrics, and the spectral fixed points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rounds as arrays
from ..functions import routes
from ..graph import Graph
from ..plans.iterate import cut, discard


def degrees(g: Graph) -> DataFrame:
    """Degree (in + out when directed, a self-loop counts 2), in, out, strengths and degree centrality."""
    e = g.edges
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0.0).alias("wi"), F.col("weight").alias("wo"))
    ends = ends.unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("weight").alias("wi"), F.lit(0.0).alias("wo")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("wi").alias("in_strength"), F.sum("wo").alias("out_strength"))
    total = g.vertices.agg(F.count(F.lit(1)).alias("__n"))
    d = g.vertices.select("id").join(sums, "id", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    d = d.withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("strength", F.col("in_strength") + F.col("out_strength"))
    return d.withColumn("degree_centrality", F.when(F.col("__n") <= 1, 1.0).otherwise(F.col("degree") / (F.col("__n") - 1))).drop("__n")


def global_basic(g: Graph) -> DataFrame:
    """One row: sizes, density, degree moments."""
    d = degrees(g).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.stddev_pop("degree").alias("__sd"), F.avg("strength").alias("avg_strength"))
    m = g.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / (1 if g.directed else 2)
    both = d.crossJoin(F.broadcast(m))  # one row each
    return both.select("n_nodes", "n_edges", F.when(possible > 0, F.col("n_edges") / possible).otherwise(0.0).alias("density"), F.coalesce("avg_degree", F.lit(0.0)).alias("avg_degree"), "max_degree", (F.col("__sd") / (F.col("avg_degree") + 1e-9)).alias("degree_heterogeneity"), "avg_strength")


def triangles(g: Graph) -> DataFrame:
    """``id, triangles, degree`` of the undirected simple graph; wedges are taken at the vertex of lower degree."""
    u = g.undirected().edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    da, db = deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), deg.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = cut(u.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t")))
    wedge = o.alias("x").join(o.alias("y"), F.expr("x.s = y.s and x.t < y.t")).select(F.col("x.s").alias("s"), F.col("x.t").alias("p"), F.col("y.t").alias("q"))
    closed = wedge.join(u.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"])
    per = closed.select(F.explode(F.array("s", "p", "q")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return g.vertices.select("id").join(deg, "id", "left").join(per, "id", "left").na.fill(0)


def clustering(g: Graph) -> DataFrame:
    k = F.col("degree")
    return triangles(g).select("id", F.when(k < 2, 0.0).otherwise(2 * F.col("triangles") / (k * (k - 1))).alias("clustering"))


def transitivity(g: Graph) -> DataFrame:
    t = triangles(g).agg(F.sum("triangles").alias("t"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    return t.select(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0).alias("transitivity"))


def assortativity(g: Graph) -> DataFrame:
    """Pearson correlation of the degrees at the ends of edges (out-degree to in-degree when directed); NaN where degrees don't vary."""
    d = degrees(g)
    left, right = ("out_degree", "in_degree") if g.directed else ("degree", "degree")
    a, b = d.select(F.col("id").alias("src"), F.col(left).alias("x")), d.select(F.col("id").alias("dst"), F.col(right).alias("y"))
    m = g.arcs().join(a, "src").join(b, "dst").agg(F.covar_pop("x", "y").alias("xy"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("s"))
    return m.select(F.when(F.col("s") > 0, F.try_divide("xy", "s")).when(F.col("s") == 0, F.lit(float("nan"))).alias("degree_assortativity"))


def _power(g: Graph, arcs: DataFrame, update: Column, start: Column, rounds: int, tol: float | None, norm: bool) -> DataFrame:
    """Iterate ``x <- update(x, s, n)`` with ``s`` the weighted sum over incoming arcs; optionally L2-normed."""
    n = g.vertices.count()
    x = held = cut(g.vertices.select("id", start.alias("x")))
    for _ in range(rounds):
        s = arcs.join(x.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("weight")).alias("s"))
        y = cut(x.join(s, "id", "left").select("id", "x", F.coalesce("s", F.lit(0.0)).alias("s")).select("id", "x", update.alias("y")))
        discard(held)
        held = y
        size = (y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0) if norm else 1.0
        new = F.col("y") / F.lit(size)
        done = tol is not None and (y.agg(F.sum(F.abs(new - F.col("x")))).first()[0] or 0.0) < n * tol
        x = y.select("id", new.alias("x"))
        if done:
            break
    return x


def eigenvector(g: Graph, rounds: int = 500, tol: float | None = 1e-6, weighted: bool = False) -> DataFrame:
    """Power iteration with the shift x <- x + Ax on the undirected graph, L2-normed."""
    n = max(1, g.vertices.count())
    if routes.fits(g):
        u = g.undirected()
        return arrays.in_one_task(u, routes.numbered(u), lambda x: arrays.power(x, lambda x, s: x + s, 1.0 / n, rounds, tol, True, weighted), "id string, eigenvector double")
    arcs = g.undirected().arcs()
    arcs = cut(arcs if weighted else arcs.withColumn("weight", F.lit(1.0)))
    x = _power(g, arcs, F.col("x") + F.col("s"), F.lit(1.0 / n), rounds, tol, True)
    return x.select("id", F.col("x").alias("eigenvector"))


def pagerank(g: Graph, alpha: float = 0.85, rounds: int = 100, tol: float | None = 1e-6, weighted: bool = True) -> DataFrame:
    """Dangling mass is spread over all; stops when the L1 change is below n * tol."""
    if routes.fits(g):
        return arrays.in_one_task(g, routes.numbered(g), lambda x: arrays.pagerank(x, alpha, rounds, tol, weighted), "id string, pagerank double")
    n = g.vertices.count()
    arcs = g.arcs() if weighted else g.arcs().withColumn("weight", F.lit(1.0))
    out = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    w = cut(arcs.join(out, "src").where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight")))
    dangling = cut(g.vertices.select("id").join(w.select(F.col("src").alias("id")), "id", "left_anti"))
    x = held = cut(g.vertices.select("id", F.lit(1.0 / max(1, n)).alias("x")))
    lost = x.join(dangling, "id", "left_semi").agg(F.sum("x")).first()[0] or 0.0
    for _ in range(rounds):
        s = w.join(x.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("weight")).alias("s"))
        y = cut(x.join(s, "id", "left").select("id", "x", (F.lit(alpha) * (F.coalesce("s", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)).alias("y")))
        discard(held)
        held = y
        told = y.join(dangling.withColumn("__ends", F.lit(True)), "id", "left").agg(F.sum(F.abs(F.col("y") - F.col("x"))).alias("moved"), F.sum(F.when(F.col("__ends"), F.col("y"))).alias("lost")).first()
        lost = told.lost or 0.0
        x = y.select("id", F.col("y").alias("x"))
        if tol is not None and (told.moved or 0.0) < n * tol:
            break
    return x.select("id", F.col("x").alias("pagerank"))


def spectral_radius(g: Graph, rounds: int = 200) -> float:
    """Largest eigenvalue of the undirected weighted adjacency, by the Rayleigh quotient of power iteration."""
    u = g.undirected()
    arcs = cut(u.arcs())
    x = eigenvector(g, rounds, 1e-7, True)
    s = arcs.join(x.select(F.col("id").alias("src"), F.col("eigenvector").alias("x")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("weight")).alias("s"))
    return float(x.join(s, "id").agg(F.sum(F.col("s") * F.col("eigenvector"))).first()[0] or 0.0)


def katz(g: Graph, alpha: float | None = None, rounds: int = 300, tol: float | None = 1e-8) -> DataFrame:
    """x <- alpha A'x + 1, L2-normed at the end; alpha defaults to 1 / (1.1 * spectral radius)."""
    if alpha is None:
        radius = spectral_radius(g)
        alpha = 1 / (1.1 * radius) if radius > 0 else 0.0
    if routes.fits(g):
        x = cut(arrays.in_one_task(g, routes.numbered(g), lambda x: arrays.power(x, lambda x, s: alpha * s + 1, 1.0, rounds, tol, False), "id string, x double"))
    else:
        x = cut(_power(g, cut(g.arcs()), F.lit(alpha) * F.col("s") + 1, F.lit(1.0), rounds, tol, False))
    size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
    return x.select("id", (F.col("x") / F.lit(size)).alias("katz"))


def coreness(g: Graph) -> DataFrame:
    """k-core numbers: vertices peeled off by degree; beyond ``kernels.MAX_EDGES`` each takes the h-index of its neighbours' values until nothing changes."""
    if routes.fits(g):
        u = g.undirected()
        return arrays.in_one_task(u, routes.numbered(u), arrays.coreness, "id string, coreness long")
    u = cut(g.undirected().arcs().where("src <> dst").select("src", "dst"))
    core = cut(g.vertices.select("id").join(u.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core")), "id", "left").na.fill(0))
    while True:
        near = u.join(core.select(F.col("id").alias("dst"), "core"), "dst").groupBy(F.col("src").alias("id"), "core").agg(F.count(F.lit(1)).alias("n"))
        from pyspark.sql import Window

        upto = F.sum("n").over(Window.partitionBy("id").orderBy(F.col("core").desc()).rowsBetween(Window.unboundedPreceding, 0))
        h = near.withColumn("h", F.least(F.col("core"), upto)).groupBy("id").agg(F.max("h").alias("h"))
        nxt = cut(core.join(h, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("new"), "core"))
        changed = not nxt.where("new <> core").isEmpty()
        core = nxt.select("id", F.col("new").alias("core"))
        if not changed:
            return core.select("id", F.col("core").alias("coreness"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns to 0..1; a constant column stays as it is."""
    ends = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c)))
    return out.drop(*[f"__{e}_{c}" for e in ("lo", "hi") for c in columns])


def systemic_importance(frame: DataFrame, top_n: int = 5) -> DataFrame:
    """``id, score``: the mean of the scaled betweenness, eigenvector, pagerank and coreness there are."""
    present = [c for c in ("betweenness", "eigenvector", "pagerank", "coreness") if c in frame.columns]
    if not present:
        return frame.orderBy("id").limit(top_n).select("id", F.lit(0.0).alias("score"))
    scaled = min_max(frame.select("id", *[F.col(c).cast("double").alias(c) for c in present]), present)
    score = sum((F.col(c) for c in present[1:]), F.col(present[0])) / len(present)
    return scaled.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(top_n)


def top_by_metric(metrics: DataFrame, top_n: int = 5) -> DataFrame:
    """``metric, rank, id, value``: the n highest of every numeric column."""
    from pyspark.sql import Window

    columns = [c for c, kind in metrics.dtypes if c != "id" and kind not in ("string",)]
    long = metrics.select("id", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("id", columns, "metric", "value")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("value").desc(), "id"))
    return long.withColumn("rank", rank).where(F.col("rank") <= top_n).select("metric", "rank", "id", "value")


def modularity(g: Graph, partition: DataFrame) -> DataFrame:
    """Q of ``partition(id, community)``, weighted and undirected; one row, ``q``."""
    u = g.undirected().edges
    p = partition.select("id", "community")
    e = u.join(p.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(p.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    ends = e.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("ends"))
    total = e.agg(F.sum("weight").alias("m"))
    per = ends.join(inside, "community", "left").crossJoin(F.broadcast(total))  # one row
    return per.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))
