"""End-to-end entries: the contagion run, the network report and the graph interface of return series."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import contagion, dependency, features, metrics, multilayer, paths, structure, temporal
from ..sources import network
from .iterate import cut


@dataclass(frozen=True)
class Config:
    corr_threshold: float = 0.3
    granger_alpha: float = 0.05
    mi_threshold: float = 0.1
    te_threshold: float = 0.05
    window: int = 60
    step: int = 10
    min_agreement: int = 2
    fusion_threshold: float = 0.1


@dataclass
class Report:
    """A report's parts, each a DataFrame."""

    parts: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.parts[name]


def global_metrics(g: Graph) -> DataFrame:
    """The full one-row bundle: sizes, degrees, clustering, components, paths on the largest one, assortativity."""
    base = metrics.global_basic(g)
    for part in (metrics.clustering(g).agg(F.avg("clustering").alias("avg_clustering")), metrics.transitivity(g), paths.path_lengths(g), metrics.assortativity(g)):
        base = base.crossJoin(F.broadcast(part))  # one row each
    return base


def node_bundle(g: Graph) -> DataFrame:
    """``node`` and title-case degree, betweenness, eigenvector and clustering, as older reports have them."""
    out = metrics.degrees(g).select("id", "degree")
    for part in (paths.betweenness(g), metrics.eigenvector(g, rounds=1000), metrics.clustering(g)):
        out = out.join(part, "id", "left")
    return out.na.fill(0).select(F.col("id").alias("Node"), F.col("degree").alias("Degree"), F.col("betweenness").alias("Betweenness"), F.col("eigenvector").alias("Eigenvector"), F.col("clustering").alias("Clustering"))


def global_bundle(g: Graph) -> DataFrame:
    """One row of the undirected graph: sizes (edges as given), density, clustering, path length (null unless connected)."""
    u = g.undirected()
    base = metrics.global_basic(u).select(F.col("n_nodes").alias("num_nodes"), "density")
    edges = g.edges.agg(F.count(F.lit(1)).alias("num_edges"))
    near = metrics.clustering(u).agg(F.avg("clustering").alias("avg_clustering"))
    far = paths.path_lengths(u).select(F.when((F.col("n_components") == 1) & (F.col("avg_path_length").isNotNull()), F.col("avg_path_length")).alias("avg_shortest_path_length"))
    for part in (edges, near, far):
        base = base.crossJoin(F.broadcast(part))  # one row each
    return base.select("num_nodes", "num_edges", "density", "avg_clustering", "avg_shortest_path_length")


def headline_bundle(g: Graph) -> DataFrame:
    """One row with the headings of older reports; density and degree of the directed graph."""
    base = metrics.global_basic(g)
    near = metrics.clustering(g).agg(F.avg("clustering").alias("near"))
    return base.crossJoin(F.broadcast(near)).select(F.col("n_nodes").alias("Number of Banks"), F.col("n_edges").alias("Number of Exposures"), F.col("density").alias("Density"), F.col("avg_degree").alias("Average Degree"), F.col("near").alias("Average Clustering"))  # one row


def network_report(g: Graph, top_n: int = 5) -> Report:
    g = Graph(cut(g.vertices), cut(g.edges), g.directed)
    central = cut(features.centralities(g))
    groups = cut(structure.louvain(g))
    curve = cut(structure.attack_curve(g, structure.attack_order(g, "betweenness")))
    return Report({
        "global": global_metrics(g),
        "centrality": central,
        "top_nodes": metrics.systemic_importance(central, top_n),
        "communities": groups,
        "modularity": metrics.modularity(g, groups),
        "robustness": structure.fragility(curve, g.vertices.count()),
        "spectral": structure.spectral_profile(g),
    })


def contagion_run(spark: SparkSession, csv: str, attack: str | None = None, initial: list[str] | None = None, threshold: float = 0.4, model: str | None = None) -> Report:
    """Load, choose seeds, spread by threshold and by balance sheets, describe what survives."""
    g = network.load_network(spark, csv)
    g = Graph(cut(g.vertices), cut(g.edges))
    seeds = cut(contagion.initial_failures(g, attack, initial))
    failed = contagion.threshold_contagion(g, seeds, threshold)
    cascade, losses = contagion.balance_sheet_cascade(g, seeds)
    out = {"seeds": seeds, "contagion": failed, "over_time": contagion.failures_over_time(failed), "cascade": cascade, "losses": losses, "global_before": metrics.global_basic(g), "global_after": metrics.global_basic(g.without(failed)), "node_metrics": features.node_metrics(g)}
    if model:
        out["risk"] = features.failure_risk(g, failed, model)
    return Report(out)


class GraphInterface:
    """Returns to layers, layers to fused graphs, graphs to matrices and features."""

    def __init__(self, returns: DataFrame, external: DataFrame | None = None, config: Config | None = None, **overrides) -> None:
        self.returns, self.external = returns, external
        self.config = replace(config or Config(), **overrides)
        self._layers: DataFrame | None = None
        self._central: dict[str, DataFrame] = {}

    def build_all(self) -> GraphInterface:
        """Nine dependency layers and two fusions, as one table of layers."""
        c = self.config
        suite = dependency.correlation_suite(self.returns, c.corr_threshold) | dependency.causality_suite(self.returns, c.granger_alpha, c.mi_threshold, c.te_threshold)
        m = multilayer.Multiplex.from_suite(suite)
        self.multiplex = multilayer.Multiplex(m.layers, self.returns.select(F.col("asset").alias("id")).distinct(), m.names)
        fused = {"fused_eigen": multilayer.fuse_eigenvalue(self.multiplex, c.fusion_threshold), "fused_intersect": multilayer.fuse_intersection(self.multiplex, c.min_agreement)}
        out = self.multiplex.layers
        for name, e in fused.items():
            out = out.unionByName(e.select(F.lit(name).alias("layer"), F.lit(False).alias("directed"), F.col("a").alias("src"), F.col("b").alias("dst"), "weight"))
        self._layers = cut(out)
        return self

    @property
    def layers(self) -> DataFrame:
        if self._layers is None:
            self.build_all()
        return self._layers

    def graph(self, name: str = "fused_eigen") -> Graph:
        e = self.layers.where(F.col("layer") == name)
        first = e.select("directed").first()
        if first is None and name not in ("fused_eigen", "fused_intersect"):
            first = self.multiplex.known().where(F.col("layer") == name).select("directed").first()
            if first is None:
                raise KeyError(name)
        return Graph(self.multiplex.vertices, e.select("src", "dst", "weight"), bool(first and first[0]))

    def temporal(self, window: int | None = None, step: int | None = None) -> tuple[DataFrame, DataFrame]:
        return temporal.sliding_snapshots(self.returns, window or self.config.window, step or self.config.step, self.config.corr_threshold)

    def adjacency(self, name: str = "fused_eigen", ids: list[str] | None = None) -> DataFrame:
        """``i, j, v`` in sorted or given order of ids; unknown ids raise KeyError."""
        from ..graph import with_ordinals

        g = self.graph(name)
        v = with_ordinals(g.vertices.select("id"), "id")
        if ids is not None:
            spark = v.sparkSession
            given = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, ord long")
            missing = given.join(v, "id", "left_anti").first()
            if missing is not None:
                raise KeyError(missing.id)
            v = given
        return g.arcs().join(v.select(F.col("id").alias("src"), F.col("ord").alias("i")), "src").join(v.select(F.col("id").alias("dst"), F.col("ord").alias("j")), "dst").select("i", "j", F.col("weight").alias("v"))

    def edge_index(self, name: str = "fused_eigen") -> DataFrame:
        return features.edge_index(self.graph(name))

    def node_features(self, name: str = "fused_eigen", centrality: bool = True, external: bool = True) -> DataFrame:
        g = self.graph(name)
        if centrality:
            if name not in self._central:
                self._central[name] = cut(features.centralities(g))
            base = self._central[name]
        elif external and self.external is not None:
            base = g.vertices.select("id")
        else:
            return metrics.degrees(g).select("id", "degree")
        return features.with_external(base, self.external if external else None)

    def summary(self) -> DataFrame:
        """One row a layer, the fused ones and those without edges included."""
        layers, spark = self.layers, self.returns.sparkSession
        fused = spark.createDataFrame([("fused_eigen", False), ("fused_intersect", False)], "layer string, directed boolean")
        return multilayer.layer_summary(multilayer.Multiplex(layers, self.multiplex.vertices, self.multiplex.known().unionByName(fused)))


def graph_interface(returns: DataFrame, external: DataFrame | None = None, **overrides) -> GraphInterface:
    return GraphInterface(returns, external, **overrides).build_all()
