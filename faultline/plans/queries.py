"""The registered queries of the library's operators on the tables at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import contagion, dependency, embedding, features, metrics, multilayer, paths, structure, temporal
from ..sources import network
from ..sources.returns import clean
from ..sources.tables import by_number, daily_volume, deliveries, delivery_graph, event_layers, event_series, monthly, most_exposed, supplier_nations, table, trades
from . import facade
from .iterate import cut

ROUNDS = 10


def _cached(g: Graph) -> Graph:
    return Graph(cut(g.vertices), cut(g.edges), g.directed)


def _directed(spark: SparkSession, d: str, with_capital: bool = False) -> Graph:
    return _cached(delivery_graph(spark, d, with_capital))


def _undirected(spark: SparkSession, d: str) -> Graph:
    return _cached(delivery_graph(spark, d).undirected())


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def edge_load_sum(spark, d):
    return _r6(network.sum_edges(trades(spark, d).withColumn("exposure", (F.col("v") / 1e6).cast("string"))), "exposure")


def edge_load_last(spark, d):
    return _r6(network.last_edges(trades(spark, d), ["l_orderkey", "l_linenumber", "v"], "v"), "weight")


def capital_buffer(spark, d):
    e = deliveries(spark, d)
    v = Graph.from_edges(e, weight="exposure").vertices
    out = network.out_exposure(v, e)
    return out.select("id", F.round((0.10 + 0.20 * by_number("id")) * (F.col("out") + 10), 2).alias("capital"))


def degree_metrics(spark, d):
    m = metrics.degrees(_directed(spark, d))
    return _r6(m.select("id", "degree", "in_degree", "out_degree", "degree_centrality", "in_strength", "out_strength"), "degree_centrality", "in_strength", "out_strength")


def global_basic(spark, d):
    return _r6(metrics.global_basic(_directed(spark, d)), "density", "avg_degree", "degree_heterogeneity", "avg_strength")


def clustering(spark, d):
    return _r6(metrics.clustering(_undirected(spark, d)), "clustering")


def transitivity(spark, d):
    return _r6(metrics.transitivity(_undirected(spark, d)), "transitivity")


def assortativity(spark, d):
    return _r6(metrics.assortativity(_undirected(spark, d)), "degree_assortativity")


def components(spark, d):
    return paths.components(_undirected(spark, d))


def bfs_paths(spark, d):
    return paths.bfs(_directed(spark, d)).select("root", "id", F.col("dist").cast("long").alias("dist"))


def closeness(spark, d):
    return _r6(paths.closeness(_directed(spark, d)), "closeness")


def harmonic(spark, d):
    return _r6(paths.harmonic(_directed(spark, d)), "harmonic")


def path_length(spark, d):
    return _r6(paths.path_lengths(_directed(spark, d).undirected()), "lcc_fraction", "avg_path_length")


def betweenness(spark, d):
    return _r6(paths.betweenness(_directed(spark, d).undirected()), "betweenness")


def betweenness_weighted(spark, d):
    return _r6(paths.betweenness(_directed(spark, d), weighted=True), "betweenness")


def pagerank_k(spark, d):
    return _r6(metrics.pagerank(_directed(spark, d), rounds=ROUNDS, tol=None), "pagerank")


def eigenvector_k(spark, d):
    return _r6(metrics.eigenvector(_directed(spark, d), rounds=ROUNDS, tol=None), "eigenvector")


def katz_k(spark, d):
    return _r6(metrics.katz(_directed(spark, d), alpha=0.001, rounds=ROUNDS, tol=None), "katz")


def coreness(spark, d):
    return metrics.coreness(_undirected(spark, d))


def all_centralities(spark, d):
    return features.centralities(_directed(spark, d))


def systemic_importance(spark, d):
    """From betweenness, eigenvector and pagerank (fixed rounds) and coreness."""
    g = _directed(spark, d)
    frame = g.vertices.select("id")
    for part in (paths.betweenness(g.undirected()), metrics.eigenvector(g, rounds=ROUNDS, tol=None), metrics.pagerank(g, rounds=ROUNDS, tol=None), metrics.coreness(g)):
        frame = frame.join(part, "id", "left")
    return _r6(metrics.systemic_importance(frame.na.fill(0), 5), "score")


def top_influential(spark, d):
    m = metrics.degrees(_directed(spark, d)).select("id", "degree", "in_degree", "in_strength")
    return _r6(metrics.top_by_metric(m, 5).withColumn("rank", F.col("rank").cast("long")), "value")


def modularity(spark, d):
    return _r6(metrics.modularity(_directed(spark, d), supplier_nations(spark, d)), "q")


def communities_greedy(spark, d):
    return structure.greedy_communities(_undirected(spark, d))


def communities_louvain(spark, d):
    return structure.louvain(_undirected(spark, d))


def communities_spectral(spark, d):
    return structure.spectral_communities(_undirected(spark, d), 3)


def attack_curve(spark, d):
    g = _directed(spark, d).undirected()
    return _r6(structure.attack_curve(g, structure.attack_order(g, "degree")), "fraction_removed", "lcc")


def attack_random(spark, d):
    g = _directed(spark, d).undirected()
    return _r6(structure.attack_curve(g, structure.attack_order(g, "random")), "fraction_removed", "lcc", "edges")


def fragility(spark, d):
    g = _directed(spark, d).undirected()
    curve = structure.attack_curve(g, structure.attack_order(g, "degree"))
    return structure.fragility(curve, g.vertices.count())


def spectral_profile(spark, d):
    return structure.spectral_profile(_directed(spark, d))


def contagion_threshold(spark, d):
    g = _directed(spark, d)
    return contagion.threshold_contagion(g, most_exposed(g), 0.4).select("id", F.col("step").cast("long").alias("step"))


def contagion_legacy(spark, d):
    g = _directed(spark, d)
    return contagion.threshold_contagion(g, most_exposed(g), 0.3, direction="in", max_steps=10).select("id", F.col("step").cast("long").alias("step"))


def failures_over_time(spark, d):
    g = _directed(spark, d)
    return contagion.failures_over_time(contagion.threshold_contagion(g, most_exposed(g), 0.4)).select(F.col("step").cast("long").alias("step"), "new", "cumulative")


def balance_sheet_cascade(spark, d):
    g = _directed(spark, d, True)
    failed, losses = contagion.balance_sheet_cascade(g, most_exposed(g))
    out = losses.join(failed, "id", "full_outer")
    return _r6(out.select("id", F.col("step").cast("long").alias("step"), F.coalesce("loss", F.lit(0.0)).alias("loss")), "loss")


def debtrank_k(spark, d):
    g = _directed(spark, d)
    return _r6(contagion.debtrank_rounds(g, most_exposed(g), 0.5, 5), "h")


def debtrank(spark, d):
    g = _directed(spark, d)
    return contagion.debtrank(g, most_exposed(g))


def contagion_index(spark, d):
    return _r6(contagion.contagion_index(_directed(spark, d)), "contagion_index")


def contagion_index_undirected(spark, d):
    return contagion.contagion_index(_directed(spark, d).undirected())


def shock_topk(spark, d):
    scores = metrics.degrees(_directed(spark, d)).select("id", "degree_centrality")
    return contagion.top_k(scores, "degree_centrality", 5).withColumn("rank", F.col("rank").cast("long"))


def survivor_subgraph(spark, d):
    g = _directed(spark, d)
    return g.without(contagion.threshold_contagion(g, most_exposed(g), 0.8)).edges.select("src", "dst")


def pearson_graph(spark, d):
    return dependency.pearson_graph(monthly(spark, d), 0.2, None, 30).select("a", "b", "weight", "n_obs")


def spearman_graph(spark, d):
    return dependency.spearman_graph(monthly(spark, d), 0.2, None, 30).select("a", "b", "weight", "n_obs")


def pearson_significant(spark, d):
    """At the operator's own p cut-off of 0.05, whatever the correlation."""
    return dependency.pearson_graph(monthly(spark, d), 0.0, 0.05, 30).select("a", "b", "weight", "n_obs")


def spearman_significant(spark, d):
    return dependency.spearman_graph(monthly(spark, d), 0.0, 0.05, 30).select("a", "b", "weight", "n_obs")


def partial_corr_graph(spark, d):
    """Every pair, from the shrunk precision matrix; the sparse one leaves no edge between these series."""
    return dependency.partial_correlation_graph(monthly(spark, d), 0.0, "shrunk")


def spectral_learning(spark, d):
    return dependency.spectral_graph_learning(event_series(spark, d, "day"), 0.0)


def _monthly_edges(spark, d) -> DataFrame:
    e = dependency.correlations(clean(monthly(spark, d))).where("n_obs >= 4 and r is not null and not isnan(r)")
    return dependency.with_distance(e.select("a", "b", F.round("r", 6).alias("weight")))


def distance_graph(spark, d):
    return _r6(_monthly_edges(spark, d), "distance")


def topk_sparsify(spark, d):
    e = _monthly_edges(spark, d).withColumnsRenamed({"a": "src", "b": "dst"})
    return structure.keep_top(e.select("src", "dst", "weight"), 0.2)


def mst(spark, d):
    e = _monthly_edges(spark, d).withColumnsRenamed({"a": "src", "b": "dst"})
    return structure.spanning_forest(e).select("src", "dst", "distance")


def pmfg(spark, d):
    return structure.planar_filter(dependency.as_graph(_monthly_edges(spark, d)))


def granger_tests(spark, d):
    return dependency.granger_tests(event_series(spark, d, "hour"), 3)


def granger_graph(spark, d):
    """With adjusted p-values; what is left at 0.5, as independent series leave nothing at 0.05."""
    return dependency.granger_graph(event_series(spark, d, "hour"), 3, 0.5)


def bh_adjust(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", ((F.pmod(F.col("s_suppkey") * 7919, F.lit(100003)) + 1) / 100003.0).alias("p_value"))
    return _r6(dependency.bh_adjust(s), "p_value", "p_adj")


def mi_hist(spark, d):
    return dependency.mutual_information_histogram(event_series(spark, d, "hour"), 0.0)


def mi_knn(spark, d):
    return dependency.mutual_information_knn(event_series(spark, d, "hour"), 0.0)


def transfer_entropy(spark, d):
    return dependency.transfer_entropy_graph(event_series(spark, d, "hour"), 0.0)


def layer_union(spark, d):
    return event_layers(spark, d).layers.select("layer", "src", "dst", "weight")


def layer_summary(spark, d):
    return multilayer.layer_summary(event_layers(spark, d)).drop("directed")


def supra_adjacency(spark, d):
    return multilayer.supra_adjacency(event_layers(spark, d))


def supra_laplacian(spark, d):
    return multilayer.supra_laplacian(event_layers(spark, d))


def layer_importance(spark, d):
    return _r6(multilayer.layer_importance(event_layers(spark, d)), "score")


def fuse_weighted(spark, d):
    return _r6(multilayer.fuse_weighted(event_layers(spark, d), None, 0.05), "weight")


def fuse_eigen(spark, d):
    return _r6(multilayer.fuse_eigenvalue(event_layers(spark, d), 0.05), "weight")


def fuse_intersection(spark, d):
    return _r6(multilayer.fuse_intersection(event_layers(spark, d), 2), "weight")


def layer_jaccard(spark, d):
    return _r6(multilayer.layer_jaccard(event_layers(spark, d)), "jaccard")


def layer_degree_corr(spark, d):
    return _r6(multilayer.layer_degree_correlation(event_layers(spark, d)), "corr")


def _sliding(spark, d):
    return temporal.sliding_snapshots(monthly(spark, d), 36, 6, 0.3, 30)


def sliding_corr(spark, d):
    return _sliding(spark, d)[1]


def expanding_corr(spark, d):
    return temporal.expanding_snapshots(monthly(spark, d), 36, 6, 0.3)[1]


def _assets(spark, d, snaps: DataFrame) -> DataFrame:
    ids = monthly(spark, d).agg(F.collect_set("asset").alias("ids"))  # one row: the series' names
    return snaps.select("snap_id").crossJoin(F.broadcast(ids)).select("snap_id", F.explode("ids").alias("id"))


def evolution_metrics(spark, d):
    snaps, edges = _sliding(spark, d)
    e = temporal.evolution(snaps, edges, _assets(spark, d, snaps))
    return _r6(e, "density", "avg_weight", "avg_clustering", "edge_turnover").withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


def edge_turnover(spark, d):
    return evolution_metrics(spark, d).select("ts", "edge_turnover")


def structural_breaks(spark, d):
    z = temporal.structural_breaks(daily_volume(spark, d), "density", 1.5)
    return _r6(z, "z").withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


def anomaly_flags(spark, d):
    z = temporal.anomaly_flags(daily_volume(spark, d), "density", 10, 2.0)
    return _r6(z, "z").withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


def temporal_degree(spark, d):
    snaps, edges = _sliding(spark, d)
    return _r6(temporal.temporal_centrality(edges, _assets(spark, d, snaps), "degree"), "value")


def temporal_betweenness(spark, d):
    snaps, edges = _sliding(spark, d)
    return _r6(temporal.temporal_centrality(edges, _assets(spark, d, snaps), "betweenness"), "value")


def ewm_corr(spark, d):
    return _r6(temporal.ewm_correlations(event_series(spark, d, "day")), "corr")


def random_walks(spark, d):
    return embedding.random_walks(_undirected(spark, d))


def node2vec(spark, d):
    return embedding.node2vec(_undirected(spark, d))


def node_features(spark, d):
    return features.node_features(_directed(spark, d, True))


def edge_index(spark, d):
    return features.edge_index(_directed(spark, d)).select("src_ix", "dst_ix")


def shock_scenarios_lr(spark, d):
    g = _directed(spark, d, True)
    scenarios = cut(features.shock_scenarios(g))
    return features.train_scenarios(g, scenarios)[1]


def failure_risk(spark, d):
    g = _directed(spark, d, True)
    return features.failure_risk(g, contagion.threshold_contagion(g, most_exposed(g), 0.4))


def suite_summary(spark, d):
    return facade.graph_interface(event_series(spark, d, "hour"), corr_threshold=0.02, mi_threshold=0.0, te_threshold=0.0, fusion_threshold=0.0).summary()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        "edge_load_sum edge_load_last capital_buffer degree_metrics global_basic clustering transitivity assortativity components "
        "bfs_paths closeness harmonic path_length betweenness betweenness_weighted pagerank_k eigenvector_k katz_k coreness all_centralities "
        "systemic_importance top_influential modularity communities_greedy communities_louvain communities_spectral attack_curve attack_random "
        "fragility spectral_profile contagion_threshold contagion_legacy failures_over_time balance_sheet_cascade debtrank_k debtrank "
        "contagion_index contagion_index_undirected shock_topk survivor_subgraph pearson_graph spearman_graph pearson_significant spearman_significant partial_corr_graph "
        "spectral_learning distance_graph topk_sparsify mst pmfg granger_tests granger_graph bh_adjust mi_hist mi_knn transfer_entropy layer_union "
        "layer_summary supra_adjacency supra_laplacian layer_importance fuse_weighted fuse_eigen fuse_intersection layer_jaccard "
        "layer_degree_corr sliding_corr expanding_corr evolution_metrics edge_turnover structural_breaks anomaly_flags temporal_degree "
        "temporal_betweenness ewm_corr random_walks node2vec node_features edge_index shock_scenarios_lr failure_risk suite_summary"
    )
    return {n: globals()[n] for n in names.split()}
