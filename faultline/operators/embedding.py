"""Random walks and vertex embeddings."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..graph import Graph
from ..plans.iterate import cut


def random_walks(g: Graph, length: int = 30, walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """``id, walk, path``: biased second-order walks, every choice a hash of (seed, start, walk, step).

    Going back weighs 1/p, a common neighbour 1, elsewhere 1/q; a dead end stops the walk.
    """
    import zlib

    def of(v: str, adj: dict) -> list[tuple]:
        out = []
        for k in range(walks):
            path, before = [v], None
            while len(path) < length:
                near = [w for w, _ in adj.get(path[-1], ())]
                if not near:
                    break
                if before is None:
                    weight = [1.0] * len(near)
                else:
                    known = {w for w, _ in adj.get(before, ())}
                    weight = [1 / p if w == before else 1.0 if w in known else 1 / q for w in near]
                u = zlib.crc32(f"{seed}|{v}|{k}|{len(path)}".encode()) / 2**32 * sum(weight)
                at = 0
                while at < len(near) - 1 and u >= weight[at]:
                    u -= weight[at]
                    at += 1
                before = path[-1]
                path.append(near[at])
            out.append((v, k, path))
        return out

    if g.edges.count() * (1 if g.directed else 2) > kernels.MAX_EDGES:
        return walks_by_joins(g, length, walks, p, q, seed)
    return kernels.per_vertex(g, of, "id string, walk int, path array<string>")


def walks_by_joins(g: Graph, length: int = 30, walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """The same walks for graphs of any size: a step of all walkers is a join with the neighbours of where they are.

    No task holds more of the graph than the neighbours of the vertices its walkers stand on.
    """
    near = cut(g.arcs().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("near")))
    state = g.vertices.select("id", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.array("id").alias("path"))
    for step in range(1, length):
        here = near.select(F.col("src").alias("__at"), "near")
        told = state.join(here, F.element_at("path", -1) == F.col("__at"), "left")
        if step == 1:
            weight = F.transform("near", lambda w: F.lit(1.0))
        else:
            before = near.select(F.col("src").alias("__from"), F.col("near").alias("known"))
            told = told.join(before, F.get("path", F.size("path") - 2) == F.col("__from"), "left")
            last = F.get("path", F.size("path") - 2)
            weight = F.transform("near", lambda w: F.when(w == last, F.lit(1 / p)).when(F.array_contains(F.coalesce("known", F.array()), w), F.lit(1.0)).otherwise(F.lit(1 / q)))
        told = told.withColumn("weight", weight)
        draw = F.crc32(F.concat_ws("|", F.lit(str(seed)), "id", F.col("walk").cast("string"), F.size("path").cast("string")).cast("binary")) / F.lit(2.0**32)
        start = F.struct((draw * F.aggregate("weight", F.lit(0.0), lambda a, w: a + w)).alias("u"), F.lit(0).alias("at"), F.lit(False).alias("stop"))
        step_on = lambda s, w: F.when(s["stop"] | (s["u"] < w), F.struct(s["u"].alias("u"), s["at"].alias("at"), F.lit(True).alias("stop"))).otherwise(F.struct((s["u"] - w).alias("u"), (s["at"] + 1).alias("at"), F.lit(False).alias("stop")))
        chosen = F.get("near", F.least(F.aggregate("weight", start, step_on)["at"], F.size("near") - 1))
        state = told.select("id", "walk", F.when(F.col("near").isNotNull(), F.concat("path", F.array(chosen))).otherwise(F.col("path")).alias("path"))
        if step % 4 == 0:
            state = cut(state)
    return state


def node2vec(g: Graph, dim: int = 32, length: int = 30, walks: int = 10, window: int = 5, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """``id, vec``: skip-gram vectors of walks, by ``pyspark.ml``; an empty graph has none."""
    paths = random_walks(g, length, walks, p, q, seed)
    if g.vertices.isEmpty():
        return g.vertices.select("id", F.array().cast("array<double>").alias("vec"))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, seed=seed, inputCol="path", outputCol="v", maxIter=1).fit(paths)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vec"))


def embed_snapshots(edges: DataFrame, dim: int = 16, length: int = 20, walks: int = 5, seed: int = 42) -> DataFrame:
    """``snap_id, id, vec`` of all snapshots in one model: vertices carry their snapshot's number."""
    tag = lambda c: F.concat_ws("|", F.col("snap_id").cast("string"), F.col(c))
    g = Graph.from_edges(edges.select(tag("a").alias("src"), tag("b").alias("dst"), "weight"), False)
    v = node2vec(g, dim, length, walks, seed=seed)
    return v.select(F.split("id", r"\|", 2)[0].cast("long").alias("snap_id"), F.split("id", r"\|", 2)[1].alias("id"), "vec")
