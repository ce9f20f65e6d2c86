"""Agreement of matches and of partitions with a truth, and differences between partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likegraph.operators.distance import apart_pairs, farthest_pairs
from likegraph.operators.frames import FeatureFrame
from likegraph.spread import joined


def _matched(best: DataFrame, truth: DataFrame) -> DataFrame:
    sizes = truth.withColumn("n", F.count("*").over(Window.partitionBy("type")))
    a = sizes.select("bodyid", F.col("type").alias("type1"), "n")
    b = truth.select(F.col("bodyid").alias("match"), F.col("type").alias("type2"))
    return best.join(a, "bodyid", "left").join(b, "match", "left")


def agreement_rate(best_matches: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rate), 100 x matches of one type over the rows whose type has another member (null if none has), and the mismatches (bodyid, type1, match, type2).

    Rows whose id or match has no truth raise an error when they are read.
    """
    rows = _matched(best_matches, truth).select("bodyid", F.when(F.col("type1").isNull() | F.col("type2").isNull(), F.raise_error(F.lit("no truth for a body"))).otherwise(F.col("type1")).alias("type1"), "match", "type2", "n").filter("n > 1")
    same = F.col("type1") == F.col("type2")
    rate = rows.agg(F.try_divide(F.sum(F.when(same, 100.0).otherwise(0.0)), F.count("*")).alias("rate"))
    return rate, rows.filter(~same).select("bodyid", "type1", "match", "type2")


def compute_vi(labels: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variation of information of (bodyid, type) partitions: (merge, split), and for each truth type VI, VI_norm, false_merge, false_split.

    merge is the entropy of truth within clusters, split that of clusters within truth, in bits.
    """
    cells = labels.select("bodyid", F.col("type").alias("l")).join(truth.select("bodyid", F.col("type").alias("g")), "bodyid").groupBy("l", "g").agg(F.count("*").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    total = cells.agg(F.sum("n").alias("whole"))
    parts = cells.withColumns({"nl": by("l"), "ng": by("g")}).crossJoin(F.broadcast(total))
    parts = parts.withColumns({"merge": F.col("n") / F.col("whole") * F.log2(F.col("nl") / F.col("n")), "split": F.col("n") / F.col("whole") * F.log2(F.col("ng") / F.col("n"))})
    summary = parts.agg(F.sum("merge").alias("merge"), F.sum("split").alias("split"))
    table = parts.groupBy("g").agg((F.sum("merge") + F.sum("split")).alias("VI"), ((F.sum("merge") + F.sum("split")) / F.max("ng")).alias("VI_norm"), F.sum("merge").alias("false_merge"), F.sum("split").alias("false_split"))
    return summary, table.withColumnRenamed("g", "type")


def _told_apart(both: DataFrame, size: int = 256) -> DataFrame:
    """(b1, b2) of the bodies (bodyid, c, o) of one c and different o.

    Bodies of a c stand in blocks of about ``size``: those of an o that has many there among themselves, all
    others mixed. Two blocks are a row with a key of its own, and blocks of one o never meet.
    """
    sizes = both.groupBy("c", "o").agg(F.count("*").alias("_n"))
    own = F.col("_n") >= size
    mixed = sizes.groupBy("c").agg(F.sum(F.when(~own, F.col("_n")).otherwise(0)).alias("rest"))
    parts = joined(sizes, mixed, ["c"]).select("c", "o", F.when(own, F.concat(F.lit("="), "o")).otherwise("").alias("of"), F.greatest(F.ceil(F.when(own, F.col("_n")).otherwise(F.col("rest")) / size).cast("int"), F.lit(1)).alias("parts"))
    placed = joined(both, parts, ["c", "o"], sizes, by=F.xxhash64("bodyid")).withColumn("part", F.pmod(F.xxhash64("bodyid", F.lit(7)), F.col("parts")).cast("int"))
    blocks = placed.groupBy("c", "of", "part").agg(F.collect_list(F.struct("bodyid", "o")).alias("rows"))
    order = Window.partitionBy("c").orderBy("of", "part")  # a row a block
    names = placed.select("c", "of", "part").distinct().withColumns({"i": F.row_number().over(order), "last": F.count("*").over(Window.partitionBy("c"))})
    others = names.select("c", F.col("i").alias("j"), F.col("of").alias("of_j"))
    wanted = names.select("c", "i", "of", F.explode(F.sequence("i", F.col("last").cast("int"))).alias("j")).join(others, ["c", "j"]).filter("of <> of_j or of = ''").select("c", "i", "j")
    blocks = blocks.join(names.select("c", "of", "part", "i"), ["c", "of", "part"]).select("c", "i", "rows")
    met = wanted.join(blocks.withColumnRenamed("rows", "x"), ["c", "i"]).join(blocks.select("c", F.col("i").alias("j"), F.col("rows").alias("y")), ["c", "j"])
    pairs = met.select("i", "j", F.explode("x").alias("p"), "y").select("i", "j", "p", F.explode("y").alias("q")).filter("p.o <> q.o and (i <> j or p.bodyid < q.bodyid)")
    return pairs.select(F.least("p.bodyid", "q.bodyid").alias("b1"), F.greatest("p.bodyid", "q.bodyid").alias("b2"))


def report_diffs(partition1: DataFrame, partition2: DataFrame, features1: FeatureFrame | None = None, features2: FeatureFrame | None = None, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs together in one partition and apart in the other: (dist, b1, b2), largest first if ordered (which moves all of them); without features (b1, b2) alone.

    The pairs of partition1 are scored by features2, and the other way round.
    """

    def apart(p, q, features):
        if features is not None:
            pairs = apart_pairs(features, p, q)
            return pairs.orderBy(F.desc("dist"), F.desc("b1"), F.desc("b2")) if ordered else pairs
        both = p.select("bodyid", F.col("type").cast("string").alias("c")).join(q.select("bodyid", F.col("type").cast("string").alias("o")), "bodyid")
        pairs = _told_apart(both.filter("c is not null and o is not null"))
        return pairs.orderBy(F.desc("b1"), F.desc("b2")) if ordered else pairs

    return apart(partition1, partition2, features2), apart(partition2, partition1, features1)


def cluster_diameter(partition: DataFrame, features: FeatureFrame) -> DataFrame:
    """(dist, b1, b2): the farthest pair of bodies that share a cluster (ties: the first by id); no row if all are alone."""
    far = farthest_pairs(features, within=partition)
    top = far.agg(F.max(F.struct("dist", (-F.col("b1")).alias("x"), (-F.col("b2")).alias("y"))).alias("m")).filter("m is not null")
    return top.select("m.dist", (-F.col("m.x")).alias("b1"), (-F.col("m.y")).alias("b2"))
