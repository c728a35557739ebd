"""Graphs as two DataFrames: ``vertices(id, ...)`` and ``edges(src, dst, weight, ...)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plans.iterate import cut


def with_ordinals(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Number rows 0.. in the given order: range partitions, their offsets, a place in each.

    Only the sizes of partitions are summed in one place.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__before", "__at")


def in_blocks(df: DataFrame, back: int, size: int = 20_000) -> DataFrame:
    """Numbered rows dealt to blocks of consecutive ones, each after the last ``back`` of the block before.

    Adds ``block`` and ``halo`` (a row that is only there for others to look back at), so that windows
    over a whole order run in many tasks.
    """
    size = max(size, 4 * back + 1)
    own = F.floor(F.col("ord") / size).cast("long")
    late = F.pmod(F.col("ord"), F.lit(size)) >= size - back
    spread = F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    return df.withColumn("block", spread).withColumn("halo", F.col("block") != F.floor(F.col("ord") / size))


@dataclass(frozen=True)
class Graph:
    """A directed graph, or an undirected one whose edges are canonical (``src <= dst``)."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = True, vertices: DataFrame | None = None, weight: str | None = "weight") -> Graph:
        """Edges without a usable weight weigh 1; rows with a null end are dropped."""
        w = F.col(weight).cast("double") if weight in edges.columns else F.lit(1.0)
        kept = [F.col(c) for c in edges.columns if c not in ("src", "dst", "weight", weight)]
        e = edges.select("src", "dst", F.coalesce(w, F.lit(1.0)).alias("weight"), *kept).where("src is not null and dst is not null")
        v = vertices if vertices is not None else e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls(v, e, directed)

    def undirected(self, reciprocal: str = "last_ord") -> Graph:
        """One edge a pair. Of a reciprocal pair: the weight of the direction with the later source, or max, sum, mean."""
        if not self.directed:
            return self
        how = {"last_ord": F.max_by("weight", "src"), "max": F.max("weight"), "sum": F.sum("weight"), "mean": F.avg("weight")}[reciprocal]
        e = self.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(how.alias("weight"))
        return Graph(self.vertices, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), False)

    def arcs(self) -> DataFrame:
        """``src, dst, weight`` in every direction an edge can be walked."""
        e = self.edges.select("src", "dst", "weight")
        return e if self.directed else e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph on ``ids(id)``."""
        keep = ids.select("id").distinct()
        e = self.edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.vertices.join(keep, "id", "left_semi"), e.select(*self.edges.columns), self.directed)

    def without(self, ids: DataFrame) -> Graph:
        """The subgraph of the vertices that are not in ``ids(id)`` (survivors of a contagion)."""
        return self.induced(self.vertices.join(ids.select("id").distinct(), "id", "left_anti"))
