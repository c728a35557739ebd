"""Networks, series and layers derived from the TPC-H-like and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, in_blocks, with_ordinals
from ..operators.multilayer import Multiplex
from ..plans.iterate import cut, discard
from .network import capital


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(c: str):
    return F.lpad(F.col(c).cast("string"), 2, "0")


def _supplier(c: str):
    return F.lpad(F.col(c).cast("string"), 8, "0")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an exposure of the supplier's nation to the customer's."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = l.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return j.select(_nation("s_nationkey").alias("source"), _nation("c_nationkey").alias("target"), "v", "l_orderkey", "l_linenumber")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, exposure`` in ten thousands: a supplier is exposed to the next one of the same part on the same day.

    Every line item counts; consecutive ones of a part and day are linked, so links grow with the rows.
    """
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", _supplier("l_suppkey").alias("dst"), F.col("l_extendedprice").alias("v"))
    before = F.lag("dst").over(Window.partitionBy("l_partkey", "day").orderBy("l_orderkey", "l_linenumber", "dst", "v"))
    e = l.withColumn("src", before).where("src is not null and src <> dst")
    return e.groupBy("src", "dst").agg(F.round(F.sum("v") / 1e4, 6).alias("exposure"))


def by_number(id_: str):
    """A share in [0, 1) that SQL can reproduce: from the number in an id."""
    return F.pmod(F.col(id_).cast("long") * 37, F.lit(100)) / 100.0


def delivery_graph(spark: SparkSession, sf_dir: str, with_capital: bool = False) -> Graph:
    """The network of ``deliveries``, directed; vertices are the suppliers that have a link."""
    e = deliveries(spark, sf_dir)
    g = Graph.from_edges(e, weight="exposure")
    if not with_capital:
        return g
    return Graph(g.vertices.join(capital(g.vertices, e, share=by_number("id")), "id"), g.edges)


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, community``: the nation of each supplier, as a partition."""
    return table(spark, sf_dir, "supplier").select(_supplier("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))


def most_exposed(g: Graph, k: int = 3) -> DataFrame:
    """The vertices that most others are exposed to."""
    return g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "id").limit(k).select("id")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, asset, r``: order totals of each nation's customers by whole month, in millions.

    The month of the last order counts only if that order is of the month's last day.
    """
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null").select("o_custkey", "o_totalprice", F.date_trunc("month", "o_orderdate").alias("t"))
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("__end"))
    end = F.col("__end")
    o = o.crossJoin(F.broadcast(last)).where((F.col("t") < F.date_trunc("month", end)) | (F.to_date(end) == F.last_day(end))).drop("__end")  # one row
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey").groupBy("t", _nation("c_nationkey").alias("asset")).agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("r"))


def event_series(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """``t, asset, r``: summed values of each event type by hour or day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc(unit, "ts").alias("t"), F.col("event_type").alias("asset")).agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 6).alias("r"))


def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("density"))


def event_layers(spark: SparkSession, sf_dir: str) -> Multiplex:
    """A layer an event type: users that follow each other in time."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.lpad(F.col("user_id").cast("string"), 8, "0").alias("u"))
    # Blocks of the order by type and time, each with the row before it: no type has to fit a task.
    e = in_blocks(with_ordinals(e, "event_type", "ts", "event_id"), 1)
    w = Window.partitionBy("block").orderBy("ord")
    e = e.withColumn("v", F.when(F.lag("event_type").over(w) == F.col("event_type"), F.lag("u").over(w)))
    e = e.where("not halo and v is not null and u <> v")
    # Written, as a window and the sums after it can't make room for each other in a task; layers, as they are read several times.
    pairs = cut(e.select(F.col("event_type").alias("layer"), F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")), "follows")
    layers = cut(pairs.groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), "layers")
    discard(pairs)
    return Multiplex.of(layers.withColumn("directed", F.lit(False)))

