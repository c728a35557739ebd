"""Loading, generating and saving exposure networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..graph import Graph

#: Everything is read as text: an exposure that is no number is a value to handle, not an error.
EXPOSURES = StructType([StructField(c, StringType()) for c in ("source", "target", "exposure")])
REQUIRED = ("source", "target", "exposure")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on partitions or order."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; its columns by name, as text."""
    return spark.read.option("header", True).csv(path)


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Missing required column: {name}")


def sum_edges(rows: DataFrame, weighted: bool = True) -> DataFrame:
    """``src, dst, exposure``: repeated pairs are summed; what is no number counts 1; unweighted counts rows."""
    require_columns(rows)
    number = F.nanvl(F.col("exposure").try_cast("double"), F.lit(None).cast("double"))
    value = F.coalesce(number, F.lit(1.0)) if weighted else F.lit(1.0)
    ends = rows.select(F.col("source").cast("string").alias("src"), F.col("target").cast("string").alias("dst"), value.alias("v")).where("src is not null and dst is not null")
    return ends.groupBy("src", "dst").agg(F.sum("v").alias("exposure"))


def last_edges(rows: DataFrame, order: list[str], weight: str = "exposure") -> DataFrame:
    """``src, dst, weight``: of repeated pairs the last row counts; missing weights stay missing."""
    return rows.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.max_by(weight, F.struct(*order)).alias("weight"))


def rejected_ends(rows: DataFrame) -> DataFrame:
    """How many rows were dropped for a missing end."""
    return rows.where("source is null or target is null").agg(F.count(F.lit(1)).alias("rejected"))


def out_exposure(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    total = edges.groupBy("src").agg(F.sum("exposure").alias("out"))
    return vertices.join(total, vertices["id"] == total["src"], "left").select(vertices["id"], F.coalesce("out", F.lit(0.0)).alias("out"))


def capital(vertices: DataFrame, edges: DataFrame, seed: int = 42, share: Column | None = None) -> DataFrame:
    """``id, capital``: 10 to 30 % of (exposures given + 10), to 2 places; deterministic by id."""
    u = share if share is not None else uniform(seed, F.col("id"))
    return out_exposure(vertices, edges).select("id", F.bround((F.lit(0.10) + F.lit(0.20) * u) * (F.col("out") + 10), 2).alias("capital"))


def load_network(spark: SparkSession, path: str, weighted: bool = True, seed: int = 42) -> Graph:
    """Exposure CSV to a graph whose vertices have capital."""
    edges = sum_edges(read_csv(spark, path), weighted)
    g = Graph.from_edges(edges, weight="exposure")
    return Graph(g.vertices.join(capital(g.vertices, edges, seed), "id"), g.edges)


def load_lending(spark: SparkSession, path: str) -> Graph:
    """CSV ``lender, borrower, exposure``; the last of repeated rows counts."""
    rows = read_csv(spark, path)
    require_columns(rows, ("lender", "borrower", "exposure"))
    rows = rows.select(F.col("lender").alias("source"), F.col("borrower").alias("target"), F.col("exposure").try_cast("double").alias("exposure"), F.monotonically_increasing_id().alias("__row"))
    return Graph.from_edges(last_edges(rows, ["__row"]))


def _names(spark: SparkSession, n: int, prefix: str) -> DataFrame:
    return spark.range(1, n + 1).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), F.col("id").alias("k"))


def _coin_pairs(spark: SparkSession, n: int, prob: float, seed: int, prefix: str, ordered: bool) -> DataFrame:
    """Pairs chosen with probability ``prob``; every vertex draws its own partners from a sequence."""
    v = _names(spark, n, prefix)
    others = F.sequence(F.lit(1), F.lit(n)) if ordered else F.when(F.col("k") < n, F.sequence(F.col("k").cast("int") + 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    pairs = v.select("k", F.explode(others).alias("j")).where("k <> j")
    return pairs.where(uniform(seed, F.col("k"), F.col("j")) < prob).select(F.concat(F.lit(prefix), F.col("k")).alias("a"), F.concat(F.lit(prefix), F.col("j")).alias("b"))


def synthetic_network(spark: SparkSession, n: int = 30, prob: float = 0.08, seed: int = 42) -> Graph:
    """Random pairs; each yields a→b with chance 0.6 (0.5 to 8) and b→a with chance 0.4 (0.2 to 5)."""
    pairs = _coin_pairs(spark, n, prob, seed, "Bank_", False)
    there = pairs.where(uniform(seed + 1, F.col("a"), F.col("b")) < 0.6).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.bround(0.5 + 7.5 * uniform(seed + 2, F.col("a"), F.col("b")), 2).alias("exposure"))
    back = pairs.where(uniform(seed + 3, F.col("a"), F.col("b")) < 0.4).select(F.col("b").alias("src"), F.col("a").alias("dst"), F.bround(0.2 + 4.8 * uniform(seed + 4, F.col("a"), F.col("b")), 2).alias("exposure"))
    edges = there.unionByName(back)
    vertices = _names(spark, n, "Bank_").select("id")
    g = Graph.from_edges(edges, vertices=vertices, weight="exposure")
    return Graph(vertices.join(capital(vertices, edges, seed), "id"), g.edges)


def demo_network(spark: SparkSession, n: int = 10, seed: int = 42) -> Graph:
    """Directed pairs with chance 0.3 and weights 0.1 to 1; vertices without edges are dropped."""
    pairs = _coin_pairs(spark, n, 0.3, seed, "Bank_", True)
    return Graph.from_edges(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), (0.1 + 0.9 * uniform(seed + 1, F.col("a"), F.col("b"))).alias("weight")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_node_metrics(metrics: DataFrame, path: str, risk: DataFrame | None = None) -> None:
    """One row a vertex, with the risk column joined by id where there is one."""
    if risk is not None:
        metrics = metrics.join(risk.select(F.col("node").alias("id"), F.col("failure_prob").alias("gnn_failure_prob")), "id", "left")
    write_csv(metrics, path)


def write_risks(risk: DataFrame, path: str) -> None:
    write_csv(risk.select("node", "failure_prob"), path)
