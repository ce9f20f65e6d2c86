"""Nearest bodies without all pairs: blocks that the triangle inequality rules out never meet.

A few pivots are told apart from every body. A body's block holds others of the same nearest pivot at about the
same distance, and knows for each pivot how near and how far its bodies are; what two blocks' bodies are apart
at the least follows from that. Each block meets itself first; from then on a block needs only those that may
hold something nearer than the farthest nearest one it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likegraph.operators.frames import FeatureFrame
from likegraph.operators.pairs import NEAREST, PARTS, VALUES, Rows, each_pair, nearest_in_pair, squares
from likegraph.spread import joined
from likegraph.stored import drop_written, written

#: Pivots: their vectors and a distance a body to each are what this takes beside the bodies' own vectors.
PIVOTS = 16
#: What a distance of five decimals may be off, and rounding of sums.
OFF = 0.5e-5 + 1e-7


def _rows(table) -> Rows:
    at, of = (table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in ("at", "of"))
    starts = at.offsets.to_numpy()
    return Rows(starts - starts[0], at.flatten().to_numpy(), of.flatten().to_numpy())


def _placed(vectors: DataFrame, pivots: int, size: int) -> tuple[DataFrame, int]:
    """vectors with far (a distance to each pivot), blk and the block's number of bodies at most about size; and how many blocks there are."""
    spark = vectors.sparkSession
    chosen = vectors.withColumn("_h", F.xxhash64("bodyid", F.lit(3))).orderBy("_h", "bodyid").limit(pivots).select("at", "of").toArrow()
    shared = spark.sparkContext.broadcast(_rows(chosen.combine_chunks()))

    def told(batches):
        for batch in batches:
            d = np.sqrt(squares(_rows(batch), shared.value))
            far = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bodyid", "pos", "at", "of")), far, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], ["bodyid", "pos", "at", "of", "far", "home", "near"])

    rows = written(vectors.select("bodyid", "pos", "at", "of").mapInArrow(told, "bodyid long, pos int, at array<long>, of array<double>, far array<double>, home int, near double"), "told")
    sizes = rows.groupBy("home").agg(F.count("*").alias("_n"), F.percentile_approx("near", [k / 64 for k in range(1, 64)], 1000).alias("cuts")).collect()  # a row a pivot
    # a ring is so many of 64 parts of a pivot's bodies that it holds about ``size``; a larger one is dealt by a hash
    rings = spark.createDataFrame([(r["home"], sorted({r["cuts"][k - 1] for k in range(1, 64) if k * r["_n"] // 64 // size != (k - 1) * r["_n"] // 64 // size})) for r in sizes], "home int, cuts array<double>")
    ringed = rows.join(F.broadcast(rings), "home").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("near")))).drop("cuts")
    many = written(ringed.groupBy("home", "ring").agg(F.count("*").alias("_n")), "rings")
    parts = joined(ringed, many.select("home", "ring", F.ceil(F.col("_n") / size).cast("int").alias("parts")), ["home", "ring"], many, by=F.xxhash64("bodyid"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("bodyid", F.lit(5)), F.col("parts")).cast("int")).drop("parts")
    names = many.select("home", "ring", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / size).cast("int") - 1)).alias("part")).orderBy("home", "ring", "part").collect()
    numbers = spark.createDataFrame([(*r, k) for k, r in enumerate(names)], "home int, ring int, part int, blk int")
    placed = written(parts.join(F.broadcast(numbers), ["home", "ring", "part"]).select("bodyid", "pos", "at", "of", "far", "blk"), "placed")
    drop_written(rows, many)
    return placed, len(names)


def nearest_by_pivots(features: FeatureFrame, distance, size: int, pivots: int = PIVOTS, counted: dict | None = None) -> DataFrame:
    """(bodyid, dist, lo, hi, other) as ``pairs.nearest`` gives it for distance, a function of two blocks of five decimals.

    counted gets the pairs of blocks that met and all there are.
    """
    placed, many = _placed(written(features.vectors(), "vectors"), pivots, size)
    schema, names = "bodyid long, dist double, lo long, hi long, other long", ["bodyid", "dist", "lo", "hi", "other"]
    best = F.min(F.struct("dist", "lo", "hi", "other")).alias("b")
    find = nearest_in_pair(distance)
    rows = placed.withColumns({"grp": F.lit(""), "last": F.lit(many - 1)})
    own = written(each_pair(rows.withColumns({"grp": F.col("blk").cast("string"), "blk": F.lit(0), "last": F.lit(0)}), find, schema, names), "own")
    # a body alone in its block has none yet
    bounds = placed.select("blk", "bodyid", F.posexplode("far").alias("p", "d")).groupBy("blk", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    bounds = bounds.groupBy("blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("of"))
    most = placed.select("blk", "bodyid").join(own.groupBy("bodyid").agg(F.min("dist").alias("d")), "bodyid", "left").groupBy("blk").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("most"))
    bounds = written(bounds.join(most, "blk"), "bounds")
    other = bounds.select(F.col("blk").alias("j"), F.col("of").alias("of_j"), F.col("most").alias("most_j"))
    both = bounds.select(F.col("blk").alias("i"), "of", "most", F.explode(F.sequence(F.col("blk"), F.lit(many - 1))).alias("j")).filter("i < j").join(other, "j")
    apart = F.array_max(F.zip_with("of", "of_j", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"])))
    wanted = written(both.filter(apart - OFF <= F.greatest("most", "most_j")).select("i", "j"), "wanted")
    if counted is not None:
        counted |= {"met": wanted.count() + many, "all": many * (many + 1) // 2}
    # blocks are sent several at a time: a twelfth of all, fewer where their values are many
    values = placed.agg(F.sum(F.size("at"))).first()[0] or 0
    per = max(1, min(-(-many // PARTS), VALUES * many // max(values, 1)))
    met = each_pair(rows, find, schema, names, wanted=wanted, per=per, whole=NEAREST)
    return met.unionByName(own).groupBy("bodyid").agg(best).select("bodyid", "b.*")
