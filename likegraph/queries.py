"""A query for each operator, over the graph of the provided tables or over the embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likegraph.functions.process import clipped_process, combine, noop_process, piecewise_process, scaled_process, sigmoid_process
from likegraph.operators import distance, evaluate, explore, features, hierarchy, kmeans, reduce
from likegraph.operators.frames import Blocks, FeatureFrame, of_vectors
from likegraph.plans import workflow
from likegraph.sources.graph import count, parse_roi
from likegraph.sources.store import load_features, save_features
from likegraph.sources.tables import WrittenGraph, suppliers
from likegraph.stored import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _raw(blocks: Blocks, direction: str | None = None) -> DataFrame:
    rows = blocks.values.select("bodyid", "direction", "feature", F.round("value", 6).alias("value"))
    return rows.filter(F.col("direction") == direction) if direction else rows


def _long(frame: FeatureFrame) -> DataFrame:
    return frame.values.select("bodyid", "block", "feature", F.round("value", 6).alias("value"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def _graph(f) -> Query:
    return lambda spark, d: f(WrittenGraph(spark, d), suppliers(spark, d))


def _whole_graph(f) -> Query:
    """f over the graph with all its nodes as targets, so that targets are each other's partners."""

    def run(spark, d):
        g = WrittenGraph(spark, d)
        return f(g, g.nodes.select(F.col("bodyId").alias("bodyid")))

    return run


def _conn(spark: SparkSession, d: str, **options) -> FeatureFrame:
    return features.compute_connection_similarity_features(WrittenGraph(spark, d), suppliers(spark, d), **options)


def _conn_raw(custom=None, restriction=None, **options) -> Query:
    def run(spark, d):
        g = WrittenGraph(spark, d)
        who, rows = features.connections(g, suppliers(spark, d), roi_restriction=restriction)
        return _raw(features.connection_blocks(who, rows, customtypes=custom(g) if custom else None, **options))

    return run


def _processed(process) -> Query:
    return lambda spark, d: _long(_conn(spark, d, postprocess=process))


def _emb(spark: SparkSession, d: str) -> FeatureFrame:
    return of_vectors(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("bodyid"), F.col("label").alias("type"))


def _tens(spark: SparkSession, d: str) -> DataFrame:
    return _truth(spark, d).withColumn("type", F.col("bodyid") % 10)


def _nodes_roi(g, _):
    return g.nodes.select(F.col("bodyId").alias("bodyid"), F.explode(parse_roi("roiInfo")).alias("region", "v")).select("bodyid", "region", count("pre").alias("pre"), count("post").alias("post"))


def _combined(g, t):
    noop = noop_process(0.5, 0.5)
    roi = features.extract_roioverlap_features(g, t, postprocess=noop)
    conn = features.compute_connection_similarity_features(g, t, postprocess=noop)
    return _long(combine([(roi, 0.3, "roi"), (conn, 0.7, "conn"), (conn, 0.0, "none")]))


def _stored(spark, d):
    path = new_path(spark, "features")
    save_features(_conn(spark, d), path)
    return _long(load_features(spark, path))


def _agreement(which: int) -> Query:
    return lambda spark, d: evaluate.agreement_rate(distance.get_strongest_matches(_emb(spark, d)), _truth(spark, d))[which]


def _partners(rows: DataFrame) -> DataFrame:
    return _rounded(rows, "weight", "var").withColumn("bodyid", F.coalesce(F.col("bodyid").cast("string"), F.lit("median")))


def _radar(g, t):
    kinds = t.select("bodyid", (F.col("bodyid") % 3).cast("string").alias("type"))
    return _rounded(explore.features_radarchart(features.extract_roioverlap_features(g, t), kinds), "value")


def _scatter(spark, d):
    return explore.with_labels(_truth(spark, d).select("bodyid"), _tens(spark, d), _truth(spark, d))


def _fine(g):
    kind = F.concat(F.lit("seg"), (F.col("bodyId") % 4).cast("string"), F.lit("_"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("bodyId") % 3 + 1).cast("int")))
    return g.nodes.filter("bodyId >= 2000000").select(F.col("bodyId").alias("bodyid"), kind.alias("type"))


def _replayed(g, t):
    replay = features.compute_connection_similarity_features(g, t, dump_replay=True)
    return _long(features.compute_connection_similarity_features(None, use_saved_types=False, customtypes=_fine(g), replay_data=replay))


def _widest(spark, d):
    _, dist, (b1, b2) = hierarchy.hierarchical_cluster(_emb(spark, d)).get_partitions_dist_constraint(1.5, return_max=True)
    return _rounded(spark.createDataFrame([(dist, b1, b2)], "dist double, b1 long, b2 long"), "dist")


def _given(spark, d) -> kmeans.KCluster:
    """Clusters around the first ten bodies."""
    frame = _emb(spark, d)
    return kmeans.assigned(frame, frame.bodies.orderBy("pos").limit(10))


def _full_rotation(spark, d):
    """Distances after a reduction to as many components as there are columns: those before."""
    frame = _emb(spark, d)
    return _rounded(distance.compute_distance_matrix(reduce.reduce_features(frame, 10**6)[0], exact=True), "dist")


def _moments(spark, d):
    """Of the scores on all principal components: the sum and the sum of squares of their variances, and the largest covariance of two."""
    scores = reduce.reduce_features(_emb(spark, d), 10**6)[0].values.select("bodyid", "feature", "value")
    pairs = scores.withColumnsRenamed({"feature": "f", "value": "x"}).join(scores.withColumnsRenamed({"feature": "g", "value": "y"}), "bodyid").filter("f <= g")
    c = pairs.groupBy("f", "g").agg(F.covar_samp("x", "y").alias("c"))
    own = F.col("f") == F.col("g")
    return c.agg(F.round(F.sum(F.when(own, F.col("c"))), 6).alias("total"), F.round(F.sum(F.when(own, F.col("c") * F.col("c"))), 6).alias("squares"), F.round(F.max(F.when(~own, F.abs("c")).otherwise(0.0)), 6).alias("between"))


def _lloyd(spark, d):
    frame = _emb(spark, d)
    return kmeans.lloyd(frame, frame.bodies.orderBy("pos").limit(10), steps=5, tolerance=-1.0)


def _best_vi(spark, d):
    merge, split, table, clusters = hierarchy.hierarchical_cluster(_emb(spark, d)).compute_vi(_truth(spark, d))
    return _rounded(table.select("*", F.lit(merge).alias("merge"), F.lit(split).alias("split"), F.lit(clusters).cast("long").alias("clusters")), "VI", "VI_norm", "false_merge", "false_split", "merge", "split")


QUERIES: dict[str, Query] = {
    "graph_edges": _graph(lambda g, t: g.edges.select("src", "dst", "weight")),
    "graph_nodes_roi": _graph(_nodes_roi),
    "neighbors": _graph(features.extract_neighbors),
    "roi_overlap_in": _graph(lambda g, t: _raw(features.roi_overlap_blocks(g, t), "in")),
    "roi_overlap_out": _graph(lambda g, t: _raw(features.roi_overlap_blocks(g, t), "out")),
    "projection_in": _graph(lambda g, t: _raw(features.projection_blocks(g, t), "in")),
    "projection_out": _graph(lambda g, t: _raw(features.projection_blocks(g, t), "out")),
    "conn_sorted": _conn_raw(),
    "conn_collapsed": _conn_raw(sort_types=False),
    "conn_pattern_only": _conn_raw(pattern_only=True),
    "conn_roi_restricted": _conn_raw(restriction=["ASIA(L)", "ASIA(R)", "EUROPE(L)"]),
    "conn_custom_types": _conn_raw(custom=lambda g: g.nodes.filter("bodyId >= 2000000").select(F.col("bodyId").alias("bodyid"), F.concat(F.lit("seg"), (F.col("bodyId") % 4).cast("string")).alias("type"))),
    "proc_sigmoid": _processed(sigmoid_process()),
    "proc_piecewise": _processed(piecewise_process(mid=20)),
    "proc_clipped": _processed(clipped_process(start=5, stop=15)),
    "proc_noop": _processed(noop_process(0.3, 0.7)),
    "proc_scaled": _processed(scaled_process()),
    "combine_blocks": _graph(_combined),
    "non_iterative": _graph(lambda g, t: _long(workflow.non_iterative_features(g, t))),
    "feature_store": _stored,
    "distance_pairs": lambda spark, d: distance.compute_distance_matrix(_conn(spark, d)),
    "closest_to_body": lambda spark, d: distance.find_closest_neurons(1, _conn(spark, d)),
    "strongest_matches": lambda spark, d: distance.get_strongest_matches(_emb(spark, d)),
    "agreement_rate": _agreement(0),
    "agreement_mismatches": _agreement(1),
    "vi_summary": lambda spark, d: _rounded(evaluate.compute_vi(_tens(spark, d), _truth(spark, d))[0], "merge", "split"),
    "vi_table": lambda spark, d: _rounded(evaluate.compute_vi(_tens(spark, d), _truth(spark, d))[1], "VI", "VI_norm", "false_merge", "false_split"),
    "report_diffs": lambda spark, d: _rounded(evaluate.report_diffs(_truth(spark, d), _tens(spark, d), _emb(spark, d), _emb(spark, d), ordered=False)[0], "dist"),
    "cluster_diameter": lambda spark, d: _rounded(evaluate.cluster_diameter(_truth(spark, d), _emb(spark, d)), "dist"),
    "max_differences": lambda spark, d: _rounded(explore.find_max_differences(_conn(spark, d), 1, 2), "v1", "v2", "diff"),
    "max_range_features": lambda spark, d: _long(explore.find_max_variance(_conn(spark, d))),
    "partner_slots_in": _graph(lambda g, t: _partners(explore.connection_differences(g, t)[0])),
    "partner_slots_out": _graph(lambda g, t: _partners(explore.connection_differences(g, t)[1])),
    "heatmap_long": _graph(lambda g, t: _rounded(explore.features_compareheatmap(features.extract_roioverlap_features(g, t)), "value")),
    "radar_table": _graph(_radar),
    "scatter_join": _scatter,
    "scatter_coordinates": lambda spark, d: explore.features_scatterplot2d(_emb(spark, d), _tens(spark, d), _truth(spark, d)),
    "conn_morph_only": _conn_raw(custom=_fine, morph_only=True),
    "conn_replay": _graph(_replayed),
    "distance_condensed": lambda spark, d: distance.compute_distance_matrix(_conn(spark, d), condense=True),
    "report_diffs_second": lambda spark, d: _rounded(evaluate.report_diffs(_truth(spark, d), _tens(spark, d), _emb(spark, d), _emb(spark, d), ordered=False)[1], "dist"),
    "report_diffs_plain": lambda spark, d: evaluate.report_diffs(_truth(spark, d), _tens(spark, d), ordered=False)[0],
    "ward_tree": lambda spark, d: _rounded(hierarchy.hierarchical_cluster(_conn(spark, d)).merges, "height", "diameter"),
    "ward_dist_diameter": _widest,
    "kmeans_assigned": lambda spark, d: _given(spark, d).get_partitions(),
    "kmeans_assigned_vi": lambda spark, d: _rounded(_given(spark, d).compute_vi(_truth(spark, d))[2], "VI", "VI_norm", "false_merge", "false_split"),
    "pca_distances": _full_rotation,
    "pca_moments": _moments,
    "kmeans_lloyd": _lloyd,
    "kmeans_lloyd_vi": lambda spark, d: _rounded(evaluate.compute_vi(_lloyd(spark, d), _truth(spark, d))[1], "VI", "VI_norm", "false_merge", "false_split"),
    "ward_partitions": lambda spark, d: hierarchy.hierarchical_cluster(_conn(spark, d)).get_partitions(10),
    "ward_dist_constraint": lambda spark, d: hierarchy.hierarchical_cluster(_emb(spark, d)).get_partitions_dist_constraint(1.5),
    "ward_best_vi": _best_vi,
    "leaf_order": lambda spark, d: hierarchy.sort_distance_matrix(_conn(spark, d)),
    "kmeans_partitions": lambda spark, d: kmeans.kmeans_cluster(_emb(spark, d), 10).get_partitions(),
    "kmeans_vi": lambda spark, d: kmeans.kmeans_cluster(_emb(spark, d), 10).compute_vi(_truth(spark, d))[2],
    "pca": lambda spark, d: reduce.reduce_features(_emb(spark, d), 10)[0].values,
    "tsne": lambda spark, d: reduce.nonlinear_reduce_features(_emb(spark, d)),
    "workflow_simple": _whole_graph(lambda g, t: _long(workflow.refining_workflow_simple(g, t, 5, iterations=2))),
    "workflow": _whole_graph(lambda g, t: _long(workflow.refining_workflow(g, t, 5, iterations=2))),
}
