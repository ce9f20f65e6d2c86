"""Features as long tables: one row for each value that isn't the block's default."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likegraph.operators.pairs import AGAINST
from likegraph.stored import drop_written, written
from likegraph.workers import let_workers_import


@dataclass(frozen=True)
class Blocks:
    """Raw features: values(bodyid, direction, feature, value), direction in or out, over bodies(bodyid, pos)."""

    bodies: DataFrame
    values: DataFrame

    def made(self, process) -> FeatureFrame:
        """What process makes of the raw features, written until the frame is released.

        Tables are written, not cached: a cached table's plan stands in each plan that reads it, once for each
        reading, so plans of plans would fill the driver.
        """
        raw = Blocks(written(self.bodies, "bodies"), written(self.values, "raw"))
        frame = process(raw)
        if frame.alike is not None:  # dense values are made when they are read
            alike = written(frame.alike, "alike")
            return FeatureFrame(frame.bodies, frame.values, frame.defaults, (*frame.held, raw.bodies, raw.values, alike), alike)
        values = written(frame.values, "features")
        drop_written(raw.values)
        return FeatureFrame(frame.bodies, values, frame.defaults, (*frame.held, raw.bodies, values))


@dataclass(frozen=True)
class FeatureFrame:
    """values(bodyid, block, feature, value) over bodies(bodyid, pos).

    A body without a row for a feature has the block's default, 0 unless defaults says otherwise. Bodies
    without any row are whole rows of defaults. Features of equal name in two blocks are two features.
    """

    bodies: DataFrame
    values: DataFrame
    defaults: dict[str, float] = field(default_factory=dict)
    #: What is written for this frame, until it is released.
    held: tuple[DataFrame, ...] = ()
    #: Of a dense frame, fewer rows (bodyid, block, feature, value, against) between whose bodies distances are the same; against: what bodies differ by here counts against their squared distance.
    alike: DataFrame | None = None

    def release(self) -> None:
        """Deletes what is written; the frame can't be read from then on."""
        drop_written(*self.held)

    def default(self):
        out = F.lit(0.0)
        for block, value in self.defaults.items():
            out = F.when(F.col("block") == block, F.lit(value)).otherwise(out)
        return out

    def shifted(self) -> DataFrame:
        """values less the default: what is missing is 0, and differences between bodies are the same."""
        return self.values.withColumn("value", F.col("value") - self.default())

    def dense(self) -> DataFrame:
        """A row for each body and feature. For views of small frames: it has bodies x features rows."""
        features = self.values.select("block", "feature").distinct()
        return self.bodies.crossJoin(features).join(self.values, ["bodyid", "block", "feature"], "left").withColumn("value", F.coalesce("value", self.default()))

    def vectors(self) -> DataFrame:
        """(bodyid, pos, at array<long>, of array<double>): hashed features and shifted values, in order of the hash."""
        return self._gathered(self.shifted().withColumn("at", F.xxhash64("block", "feature")))

    def distance_vectors(self) -> DataFrame:
        """The same for what looks at distances alone, through ``pairs.squares``: of a dense frame the fewer rows, with columns that count against under numbers below ``AGAINST``."""
        if self.alike is None:
            return self.vectors()
        at = F.xxhash64("block", "feature")
        return self._gathered(self.alike.withColumn("at", F.when(F.col("against"), F.lit(AGAINST - 1) - F.pmod(at, F.lit(1 << 19))).otherwise(at)))

    def stored(self) -> int:
        """How many values ``distance_vectors`` has, about."""
        return (self.values if self.alike is None else self.alike).count()

    def _gathered(self, rows: DataFrame) -> DataFrame:
        let_workers_import(self.bodies.sparkSession)
        one = F.struct("at", "value")
        rows = rows.filter("value <> 0").groupBy("bodyid").agg(F.sort_array(F.collect_list(one)).alias("v"))
        empty = F.array().cast("array<struct<at:bigint,value:double>>")
        return self.bodies.join(rows, "bodyid", "left").withColumn("v", F.coalesce("v", empty)).select("bodyid", "pos", F.col("v.at").alias("at"), F.col("v.value").alias("of"))

    def feature_hashes(self) -> list[int]:
        """Hashes of all features in order of block and name, on the driver: for dense methods, whose width it is."""
        names = self.values.select("block", "feature", F.xxhash64("block", "feature").alias("at")).distinct()
        return [r["at"] for r in names.orderBy("block", "feature").collect()]


def of_vectors(rows: DataFrame, body: str, vector: str) -> FeatureFrame:
    """A frame from a table of an id and an array of numbers; positions follow the id."""
    from likegraph.sources.graph import bodies

    flat = rows.select(F.col(body).cast("long").alias("bodyid"), F.posexplode(vector)).select("bodyid", F.lit("v").alias("block"), F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 5, "0")).alias("feature"), F.col("col").cast("double").alias("value"))
    return FeatureFrame(bodies(rows.sparkSession, rows.select(F.col(body).alias("bodyid"))), flat)
