"""A weighted, typed, region-annotated directed graph as three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that one task puts in order.
RANGE = 65_536
ROI = "map<string,struct<pre:bigint,post:bigint>>"


def parse_roi(column: str) -> Column:
    """region -> (pre, post) from JSON text; null or broken text gives null."""
    return F.from_json(column, ROI)


def count(side: str) -> Column:
    """A key that is absent counts as 0."""
    return F.coalesce(F.col(f"v.{side}"), F.lit(0))


@dataclass(frozen=True)
class Graph:
    """nodes(bodyId, type, instance, status, cropped, roiInfo), edges(src, dst, weight, roiInfo), meta(superLevelRois).

    At most one edge for each ordered pair. roiInfo is JSON text. Tables stay lazy, so filters and column
    lists of each operator reach the scan.
    """

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame

    def super_rois(self, roilist: list[str] | None = None, none_region: bool = False) -> DataFrame:
        """(region): the caller's list, or that of meta, with the literal region None if asked for."""
        spark = self.meta.sparkSession
        if roilist is not None:
            return spark.createDataFrame([(r,) for r in sorted(set(roilist))], "region string")
        found = self.meta.select(F.explode("superLevelRois").alias("region"))
        return (found.union(spark.createDataFrame([("None",)], "region string")) if none_region else found).distinct()

    def touching(self, targets: DataFrame, direction: str) -> DataFrame:
        """Edges of targets (bodyid): bodyid, partner, weight, roiInfo; in: partner to body, out: body to partner. Loops are left out."""
        body, partner = ("dst", "src") if direction == "in" else ("src", "dst")
        wanted = targets.select("bodyid").distinct()
        rows = self.edges.filter(F.col("src") != F.col("dst")).select(F.col(body).alias("bodyid"), F.col(partner).alias("partner"), "weight", "roiInfo")
        return rows.join(wanted, "bodyid", "left_semi")


def bodies(spark: SparkSession, ids: list[int] | DataFrame) -> DataFrame:
    """(bodyid, pos): a list in its order, or a frame (bodyid) in ascending order; repeated ids count once."""
    if isinstance(ids, DataFrame):
        # positions by ranges of ids of about equal size, not by one task that holds all
        from pyspark.sql import Window

        rows = ids.select(F.col(ids.columns[0]).cast("long").alias("bodyid")).distinct()
        parts = min(1000, -(-rows.count() // RANGE))
        if parts <= 1:
            return rows.withColumn("pos", (F.row_number().over(Window.orderBy("bodyid")) - 1).cast("int"))
        cuts = rows.agg(F.percentile_approx("bodyid", [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
        rows = rows.withColumn("part", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("bodyid"))))
        counts = rows.groupBy("part").agg(F.count("*").alias("n"))
        before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("bodyid")) - 1)
        return ranked.join(F.broadcast(before), "part").select("bodyid", (F.col("before") + F.col("r")).cast("int").alias("pos"))
    unique = list(dict.fromkeys(int(i) for i in ids))
    return spark.createDataFrame([(b, i) for i, b in enumerate(unique)], "bodyid long, pos int")
