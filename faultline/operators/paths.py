"""Shortest paths, path-based centralities and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, routes
from ..graph import Graph
from ..plans.iterate import cut, least_reachable


def bfs(g: Graph, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``root, id, dist``: unweighted distances from each root, the root itself at 0.

    From all vertices of a graph up to ``kernels.MAX_EDGES``: in blocks of roots; else frontier by frontier.
    """
    if roots is None and max_depth is None and routes.fits(g):
        return routes.pairs(g, routes.numbered(g))
    arcs = cut(g.arcs().select("src", "dst").distinct())
    roots = g.vertices.select("id") if roots is None else roots.select("id")
    seen = front = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("dist")))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = front.select("root", F.col("id").alias("src")).join(arcs, "src").select("root", F.col("dst").alias("id")).distinct()
        front = cut(nxt.join(seen, ["root", "id"], "left_anti").withColumn("dist", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reachable(g: Graph) -> DataFrame:
    """``root, id`` for every other vertex that can be reached from root."""
    return bfs(g).where("dist > 0").select("root", "id")


def reach_counts(g: Graph) -> DataFrame:
    """``id, r``: how many other vertices can be reached from each."""
    if routes.fits(g):
        return routes.reach(g, routes.numbered(g))
    return reachable(g).groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("r"))


def distance_sums(g: Graph, distances: DataFrame | None = None) -> DataFrame:
    """``id, r, s, h, far``: of the others that reach a vertex, their number, summed distances and inverses, the greatest distance."""
    if distances is None and routes.fits(g):
        return routes.sums(g, routes.numbered(g))
    d = (bfs(g) if distances is None else distances).where("dist > 0").groupBy("id")
    return d.agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("s"), F.sum(1 / F.col("dist")).alias("h"), F.max("dist").cast("long").alias("far"))


def components(g: Graph) -> DataFrame:
    """``id, component`` (the least id of it), ignoring directions."""
    labels = least_reachable(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.select("id").join(labels, F.col("id") == F.col("v"), "left").select("id", F.coalesce("label", "id").alias("component"))


def closeness(g: Graph, distances: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Inward closeness, scaled by the share of vertices that reach the vertex; from ``distance_sums``, if given."""
    n = g.vertices.count()
    d = distance_sums(g, distances) if sums is None else sums
    value = F.when(F.col("s") > 0, F.col("r") / F.col("s") * (F.col("r") / F.lit(max(1, n - 1)))).otherwise(0.0)
    return g.vertices.select("id").join(d, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def harmonic(g: Graph, distances: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    d = (distance_sums(g, distances) if sums is None else sums).select("id", F.col("h").alias("harmonic"))
    return g.vertices.select("id").join(d, "id", "left").na.fill(0.0)


def path_lengths(g: Graph) -> DataFrame:
    """One row on the largest component: its share of vertices, diameter and average path length.

    A directed component that is not strongly connected has null lengths.
    """
    total = g.vertices.count()
    if total and routes.fits(g):
        graph = routes.numbered(g)
        per = graph.sizes()
        count, k = len(per), int(per.max())
        sums = routes.sums(g, graph, int(per.argmax()))
    else:
        comp = components(g)
        sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        count = sizes.count()
        big = cut(sizes.orderBy(F.col("size").desc(), "component").limit(1).join(comp, "component").select("id", "size"))
        k = big.count()
        sums = distance_sums(g.induced(big))
    d = sums.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("pairs"), F.max("far").alias("far"), F.sum("s").alias("all"))
    whole = F.col("pairs") == k * (k - 1)
    return d.select(F.lit(count).cast("long").alias("n_components"), F.lit(k / max(1, total)).alias("lcc_fraction"), F.when(whole, F.col("far")).cast("long").alias("diameter"), F.when(whole & (F.col("pairs") > 0), F.col("all") / F.col("pairs")).alias("avg_path_length"))


def betweenness(g: Graph, weighted: bool = False) -> DataFrame:
    """Normalised over ordered pairs; weights are lengths, and any negative one makes all values 0.

    Up to ``kernels.MAX_EDGES`` arcs blocks of roots are dealt out; beyond, unweighted values come from joins.
    """
    n = g.vertices.count()
    if weighted and not g.edges.where("weight < 0").isEmpty():
        return g.vertices.select("id", F.lit(0.0).alias("betweenness"))
    if not routes.fits(g):
        if not weighted:
            return betweenness_by_joins(g)
        raise ValueError(f"more than {kernels.MAX_EDGES} arcs or vertices; this kernel needs the arcs in every task")
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    total = routes.shares(g, routes.numbered(g), weighted).select("id", (F.col("share") * scale).alias("betweenness"))
    return g.vertices.select(F.col("id").cast("string").alias("id")).join(total, "id", "left").na.fill(0.0)


def betweenness_by_joins(g: Graph, pairs: int = 1_000_000_000) -> DataFrame:
    """Unweighted betweenness for graphs of any size: frontiers out from a batch of roots, dependencies back.

    A batch has as many roots as keep its (root, vertex) pairs below ``pairs``; nothing but joins and
    sums by (root, vertex), so no task holds the graph.
    """
    n = g.vertices.count()
    arcs = cut(g.arcs().where("src <> dst").select("src", "dst").distinct())
    batches = max(1, -(-n * n // pairs))
    total = None
    for b in range(batches):
        roots = g.vertices.select("id").where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        levels = [cut(roots.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("ways")))]
        seen = levels[0].select("root", "id")
        while True:
            front = levels[-1].select("root", F.col("id").alias("src"), "ways").join(arcs, "src").groupBy("root", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
            front = cut(front.join(seen, ["root", "id"], "left_anti"))
            if front.isEmpty():
                break
            levels.append(front)
            seen = seen.unionByName(front.select("root", "id"))
        owed = levels[-1].withColumn("owed", F.lit(0.0))
        for level in reversed(levels[:-1]):
            back = owed.select("root", F.col("id").alias("dst"), ((1 + F.col("owed")) / F.col("ways")).alias("each")).join(arcs, "dst").groupBy("root", F.col("src").alias("id")).agg(F.sum("each").alias("each"))
            if level is not levels[0]:
                part = owed.groupBy("id").agg(F.sum("owed").alias("share"))
                total = part if total is None else total.unionByName(part)
                owed = cut(level.join(back, ["root", "id"], "left").select("root", "id", "ways", (F.col("ways") * F.coalesce("each", F.lit(0.0))).alias("owed")))
            elif len(levels) > 1:
                part = owed.groupBy("id").agg(F.sum("owed").alias("share"))
                total = part if total is None else total.unionByName(part)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    ids = g.vertices.select(F.col("id").cast("string").alias("id"))
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    return ids.join(total.groupBy("id").agg((F.sum("share") * scale).alias("betweenness")), "id", "left").na.fill(0.0)
