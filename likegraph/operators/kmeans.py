"""K-means over the bodies of a frame: by Spark ML, or in Lloyd's steps over long rows from given bodies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likegraph.operators.evaluate import compute_vi
from likegraph.operators.frames import FeatureFrame
from likegraph.spread import joined
from likegraph.stored import drop_written, written


def dense_vectors(features: FeatureFrame) -> DataFrame:
    """(bodyid, pos, of array<double>) with a place for each feature."""
    names = np.array(features.feature_hashes() or [0], dtype=np.int64)
    order, width = np.argsort(names), len(names)

    def run(batches):
        for batch in batches:
            at = batch.column("at")
            out = np.zeros((batch.num_rows, width))
            out[np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy())), order[np.searchsorted(names, at.flatten().to_numpy(), sorter=order)]] = batch.column("of").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("bodyid"), batch.column("pos"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(out.ravel()))], ["bodyid", "pos", "of"])

    return features.vectors().mapInArrow(run, "bodyid long, pos int, of array<double>")


def dense_values(features: FeatureFrame) -> DataFrame:
    """(bodyid, pos, of): as dense_vectors, with defaults added again."""
    default = [float(v) for v in _defaults(features)]
    return dense_vectors(features).withColumn("of", F.zip_with("of", F.array(*map(F.lit, default)), lambda a, b: a + b)) if any(default) else dense_vectors(features)


def _defaults(features: FeatureFrame) -> list[float]:
    names = features.values.select("block", "feature", F.xxhash64("block", "feature").alias("at")).distinct()
    return [r["d"] for r in names.withColumn("d", features.default()).orderBy("block", "feature").collect()]


def kmeans_cluster(features: FeatureFrame, num_clusters: int) -> KCluster:
    # a fit that reads Python's output through a join fails where its sample ends before the join does, so it reads a table
    rows = written(dense_vectors(features), "dense").withColumn("features", array_to_vector("of"))
    model = KMeans(k=num_clusters, seed=0).fit(rows)
    return KCluster([[float(v) for v in c] for c in model.clusterCenters()], model.transform(rows).select("bodyid", "pos", "of", F.col("prediction").alias("type")))


def _norms(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(F.col("value") * F.col("value")).alias("norm"))


def _nearest_centre(who: DataFrame, rows: DataFrame, sizes: DataFrame, total: int, centres: DataFrame, names: DataFrame) -> DataFrame:
    """(bodyid, type): the nearest of centres (type, block, feature, value), of equally near ones the first, by squared lengths and products over the values that are there."""
    by_feature = centres.groupBy("block", "feature").agg(F.collect_list(F.struct("type", F.col("value").alias("c"))).alias("of"))
    met = joined(rows, by_feature, ["block", "feature"], sizes, total, by=F.xxhash64("bodyid"))
    dots = met.select("bodyid", "value", F.explode("of").alias("o")).groupBy("bodyid", F.col("o.type").alias("type")).agg(F.sum(F.col("value") * F.col("o.c")).alias("dot"))
    # a body and centre without a feature in common have no product; there are few centres
    every = F.broadcast(names.join(_norms(centres, "type"), "type", "left").select(F.collect_list(F.struct("type", F.coalesce("norm", F.lit(0.0)).alias("norm"))).alias("all")))
    told = dots.groupBy("bodyid").agg(F.map_from_entries(F.collect_list(F.struct("type", "dot"))).alias("dots"))
    far = who.select("bodyid").join(told, "bodyid", "left").join(every)
    # the body's own length is the same for each centre
    best = F.array_min(F.transform("all", lambda c: F.struct((c["norm"] - 2 * F.coalesce(F.element_at("dots", c["type"]), F.lit(0.0))).alias("d"), c["type"].alias("type"))))
    return far.select("bodyid", best["type"].alias("type"))


def lloyd(features: FeatureFrame, seeds: DataFrame, steps: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """(bodyid, type): Lloyd's steps from given bodies (bodyid, pos; few) as first centres, numbered by position.

    Ends after so many steps, or when the centres' squared moves add up to tolerance or less. A centre that
    loses all its bodies stays where it is. Rows stay long: a step joins values with the centres' values of
    their feature, so work goes with the stored values, and features that all bodies have are dealt to several tasks.
    """
    rows = written(features.shifted().filter("value <> 0").select("bodyid", "block", "feature", "value"), "values")
    sizes, total = written(rows.groupBy("block", "feature").agg(F.count("*").alias("_n")), "sizes"), rows.count()
    names = written(seeds.select("bodyid", (F.row_number().over(Window.orderBy("pos")) - 1).cast("int").alias("type")), "names")
    centres = written(rows.join(F.broadcast(names), "bodyid").select("type", "block", "feature", "value"), "centres")
    kinds = names.select("type")
    part = None
    for k in range(steps + 1):
        new_part = written(_nearest_centre(features.bodies, rows, sizes, total, centres, kinds), "assigned")
        if part is not None:
            drop_written(part)
        part = new_part
        if k == steps:
            break
        many = part.groupBy("type").agg(F.count("*").alias("n"))
        sums = rows.join(part, "bodyid").groupBy("type", "block", "feature").agg(F.sum("value").alias("s"))
        moved = sums.join(F.broadcast(many), "type").select("type", "block", "feature", (F.col("s") / F.col("n")).alias("value"))
        stay = centres.join(F.broadcast(many.select("type")), "type", "left_anti")
        fresh = written(moved.unionByName(stay), "centres")
        both = fresh.withColumnRenamed("value", "a").join(centres.withColumnRenamed("value", "b"), ["type", "block", "feature"], "full")
        shift = both.agg(F.sum(F.pow(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), F.lit(2.0)))).first()[0]
        drop_written(centres)
        centres = fresh
        if (shift or 0.0) <= tolerance:
            steps = k + 1
            new_part = written(_nearest_centre(features.bodies, rows, sizes, total, centres, kinds), "assigned")
            drop_written(part)
            part = new_part
            break
    drop_written(rows, sizes, centres, names)
    return part


def assigned(features: FeatureFrame, seeds: DataFrame) -> KCluster:
    """Clusters around given bodies (bodyid, pos; few), numbered by their position: each body goes to the nearest, of equally near ones to the first."""
    rows = dense_vectors(features)
    centres = [r["of"] for r in rows.join(F.broadcast(seeds.select("bodyid")), "bodyid", "left_semi").orderBy("pos").collect()]
    near = _with_distance(rows.crossJoin(F.broadcast(_centres(rows.sparkSession, centres))))
    best = near.groupBy("bodyid").agg(F.min_by("type", F.struct("dist", "type")).alias("type"))
    return KCluster(centres, rows.join(best, "bodyid").select("bodyid", "pos", "of", "type"))


def _centres(spark, centres: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(centres)), "type int, centre array<double>")


def _with_distance(rows: DataFrame) -> DataFrame:
    """rows (of, centre) with dist."""
    square = F.aggregate(F.zip_with("of", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("dist", F.sqrt(square))


@dataclass
class KCluster:
    """centres by number over rows (bodyid, pos, of, type)."""

    centres: list[list[float]]
    rows: DataFrame

    def get_partitions(self) -> DataFrame:
        """(bodyid, type, ord): in each cluster the body nearest its centre comes first, the others follow by position."""
        rows = _with_distance(self.rows.join(F.broadcast(_centres(self.rows.sparkSession, self.centres)), "type")).select("bodyid", "pos", "type", "dist")
        nearest = rows.groupBy("type").agg(F.min_by("bodyid", F.struct("dist", "pos")).alias("nearest"))
        order = Window.partitionBy("type").orderBy((F.col("bodyid") != F.col("nearest")).cast("int"), "pos")
        return rows.join(nearest, "type").select("bodyid", "type", (F.row_number().over(order) - 1).alias("ord"))

    def compute_vi(self, truth: DataFrame):
        summary, table = compute_vi(self.rows.select("bodyid", "type"), truth)
        got = summary.first()
        return got["merge"], got["split"], table
