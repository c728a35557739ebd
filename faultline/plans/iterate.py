"""Written states of loops: reliable cuts of lineage in the folder that all executors share.

A state is Parquet below ``spark.checkpoint.dir``. Read back, its plan is a scan whose size is that of
its files, so neither lineage nor size estimates grow from round to round, and a lost executor costs
no more than the tasks it ran. States that nothing reads any more are deleted with ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI that every executor can reach.

    Where the session names none and runs in this one process (tests, a laptop), a folder of this
    machine is made and set; a cluster must name one.
    """
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` into the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*states: DataFrame) -> None:
    """Delete the files of states that ``cut`` returned; no plan may read them any more."""
    for state in states:
        path = _written.pop(state, None)
        if path is not None:
            delete(state.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Edges that one task joins up faster than rounds of joins would.
SMALL_EDGES = 200_000


def _joined_up(edges: DataFrame, name: str) -> DataFrame:
    """``v, label`` of a counted, small edge list, by disjoint sets in one task."""
    import pyarrow as pa

    kind = edges.schema["a"].dataType

    def run(batches):
        up: dict = {}

        def root(x):
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        ids = list(up)
        yield pa.record_batch([pa.array(ids, batch_type), pa.array([root(x) for x in ids], batch_type)], names=["v", "label"])

    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    return cut(edges.select("a", "b").coalesce(1).mapInArrow(run, f"v {kind.simpleString()}, label {kind.simpleString()}"), name)


def least_reachable(edges: DataFrame, name: str = "components", small: int = SMALL_EDGES) -> DataFrame:
    """``v, label``: the least vertex reachable from each vertex that has an edge ``a, b``.

    Up to ``small`` edges are joined up in one task. Beyond, every round each vertex points to its least
    neighbour. Such pointers form trees that end in a pair pointing at each other, whose lesser one is the
    root; pointers are doubled until all lead to roots, and edges are drawn anew between roots. Vertices at
    least halve from round to round, and a doubling halves depths, so rounds are logarithmic in the number
    of vertices.
    """
    from pyspark.sql import functions as F

    def between(e: DataFrame) -> DataFrame:
        return cut(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)

    edges = between(edges)
    if edges.schema["a"].dataType.simpleString() in ("bigint", "int", "string") and edges.count() <= small:
        labels = _joined_up(edges, name)
        discard(edges)
        return labels
    roots = cut(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root")), name)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("u"), "p"), name)
        ended = F.when((F.col("y.p") == F.col("x.u")) & (F.col("x.u") < F.col("x.p")), F.col("x.u")).otherwise(F.col("x.p"))
        old, to = to, cut(to.alias("x").join(to.alias("y"), F.expr("x.p = y.u")).select("x.u", ended.alias("p")), name)
        discard(old)
        while True:
            step = to.alias("x").join(to.alias("y"), F.expr("x.p = y.u")).select("x.u", F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved"))
            old, to = to, cut(step, name)
            moved = not to.where("moved").isEmpty()
            discard(old)
            to, held = to.drop("moved"), to
            if not moved:
                break
            _written[to] = _written.pop(held)
        followed = roots.join(to, roots["root"] == to["u"], "left").select("v", F.coalesce("p", "root").alias("root"))
        near = edges.join(to, edges["a"] == to["u"]).select(F.col("p").alias("a"), "b")
        near = near.join(to, near["b"] == to["u"]).select("a", F.col("p").alias("b"))
        old = (roots, edges, held)
        roots, edges = cut(followed, name), between(near)
        discard(*old)
    discard(edges)
    least = roots.groupBy("root").agg(F.min("v").alias("label"))
    labels = cut(roots.join(least, "root").select("v", "label"), name)
    discard(roots)
    return labels
