"""Return series: long form ``t, asset, r``, adapters, deletion rules and simulated series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean(returns: DataFrame) -> DataFrame:
    """NaN becomes null and null observations are dropped."""
    return returns.withColumn("r", F.nanvl(F.col("r").cast("double"), F.lit(None).cast("double"))).where("r is not null")


def from_wide(wide: DataFrame, time: str) -> DataFrame:
    """One column an asset to long form."""
    assets = [c for c in wide.columns if c != time]
    return clean(wide.select(F.col(time).alias("t"), *assets).unpivot("t", assets, "asset", "r"))


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A pandas frame indexed by time."""
    return from_wide(spark.createDataFrame(frame.rename_axis("t").reset_index()), "t")


def to_wide(returns: DataFrame) -> DataFrame:
    return returns.groupBy("t").pivot("asset").agg(F.first("r"))


def listwise(returns: DataFrame, *group: str) -> DataFrame:
    """Keep times at which every asset (of the group) has an observation."""
    w = Window.partitionBy(*group, "t")
    assets = returns.groupBy(*group).agg(F.countDistinct("asset").alias("__n")) if group else returns.agg(F.countDistinct("asset").alias("__n"))
    here = returns.withColumn("__here", F.count("r").over(w))
    joined = here.join(assets, list(group)) if group else here.crossJoin(F.broadcast(assets))  # one row
    return joined.where("__here = __n").drop("__here", "__n")


def pairs(returns: DataFrame, ordered: bool = False, *group: str) -> DataFrame:
    """Times that two assets share, ``a, b, t, x, y``: pairwise deletion as a join on time."""
    a = returns.select(*group, "t", F.col("asset").alias("a"), F.col("r").alias("x"))
    b = returns.select(*group, "t", F.col("asset").alias("b"), F.col("r").alias("y"))
    return a.join(b, [*group, "t"]).where("a <> b" if ordered else "a < b")


def simulated(spark: SparkSession, n_assets: int = 8, n_obs: int = 300, seed: int = 0, lead_lag: bool = False, scale: float = 0.01) -> DataFrame:
    """White noise, or with each of the first assets leading the next by one step."""
    u = lambda k: F.greatest(F.lit(1e-12), F.pmod(F.xxhash64(F.lit(seed * 2 + k), "asset", "t"), F.lit(1 << 53)) / float(1 << 53))
    grid = spark.range(n_assets).select(F.concat(F.lit("Asset_"), (F.col("id") + 1).cast("string")).alias("asset"), F.explode(F.sequence(F.lit(0), F.lit(n_obs - 1))).alias("t"))
    r = grid.withColumn("r", scale * F.sqrt(-2 * F.log(u(0))) * F.cos(6.283185307179586 * u(1)))
    if not lead_lag:
        return r
    w = Window.partitionBy("t")
    before = lambda name: F.lag(F.max(F.when(F.col("asset") == name, F.col("r"))).over(w), 1).over(Window.partitionBy("asset").orderBy("t"))
    r = r.withColumn("r", F.when(F.col("asset") == "Asset_2", F.col("r") + 0.5 * F.coalesce(before("Asset_1"), F.lit(0.0))).otherwise(F.col("r")))
    return r.withColumn("r", F.when(F.col("asset") == "Asset_3", F.col("r") + 0.4 * F.coalesce(before("Asset_2"), F.lit(0.0))).otherwise(F.col("r")))


def correlated(spark: SparkSession, covariance: list[list[float]], n_obs: int = 252, seed: int = 42) -> DataFrame:
    """Multivariate normal series ``Asset_1..k`` with the given covariance; each time's values depend on (seed, t) alone."""
    import numpy as np

    try:
        low = np.linalg.cholesky(np.asarray(covariance, dtype=float))
    except np.linalg.LinAlgError as e:
        raise ValueError("a covariance must be symmetric and positive definite") from e
    noise = simulated(spark, len(low), n_obs, seed, scale=1.0).select("t", F.col("asset").alias("source"), "r")
    share = [(f"Asset_{i + 1}", f"Asset_{j + 1}", float(low[i, j])) for i in range(len(low)) for j in range(i + 1) if low[i, j]]
    share = spark.createDataFrame(share, "asset string, source string, share double")
    return noise.join(F.broadcast(share), "source").groupBy("t", "asset").agg(F.sum(F.col("r") * F.col("share")).alias("r"))  # assets squared, given by the caller
