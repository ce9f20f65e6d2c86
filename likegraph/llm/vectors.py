"""What operators on vectors have in common: which vectors count, and blocks of rows that meet in pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likegraph.spread import joined


def whole(vector: str) -> Column:
    """Whether a vector has components, all of them finite."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, odd), F.lit(False))


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(rows: DataFrame, by: list[str], size: int, number: str) -> DataFrame:
    """rows with blk and last: each group of equal ``by`` in as many blocks as it needs, by a hash of the column ``number``."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    parts = sizes.select(*by, (F.ceil(F.col("_n") / size).cast("int") - 1).alias("last"))
    return joined(rows, parts, by, sizes, by=F.xxhash64(number)).withColumn("blk", F.pmod(F.xxhash64(number, F.lit(5)), F.col("last") + 1).cast("int"))


def block_pairs(rows: DataFrame, by: list[str], columns: list[str], function: Callable, schema: str) -> DataFrame:
    """What function(x, y, same) yields, as record batches of schema, for each two blocks (of ``blocks``) of a group and each block with itself.

    x and y are struct arrays of columns. Each two blocks are a row with a key of its own, so a task holds two blocks.
    """
    of = rows.groupBy(*by, "blk", "last").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    x = of.select(*by, F.col("blk").alias("i"), F.explode(F.sequence("blk", "last")).alias("j"), F.col("rows").alias("x"))
    y = of.select(*by, F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"), F.col("rows").alias("y"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (pa.concat_arrays([batch.column(c)[k].values]) for c in "xy")
                yield from function(a, b, batch.column("i")[k].as_py() == batch.column("j")[k].as_py())

    return x.join(y, [*by, "i", "j"]).select("i", "j", "x", "y").mapInArrow(run, schema)
