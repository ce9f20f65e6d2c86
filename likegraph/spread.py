"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes; at most so many keys have more.
LEAST, MOST_KEYS = 256, 100_000


def hot_keys(sizes: DataFrame, total: int) -> DataFrame | None:
    """Of sizes (key columns, _n: rows of each key, together total), those of too many rows for one task, with _k, the parts to deal them to. At most MOST_KEYS, so they come to the driver; none: None."""
    size = max(LEAST, -(-total // MOST_KEYS))
    found = sizes.filter(F.col("_n") > size).withColumn("_k", F.ceil(F.col("_n") / size).cast("int")).drop("_n").toArrow()
    return F.broadcast(sizes.sparkSession.createDataFrame(found)) if found.num_rows else None


def dealt(many: DataFrame, hot: DataFrame | None, on: list[str], part: str = "_part", by: Column | None = None) -> DataFrame:
    """many with the part (from 0) that each row of a hot key goes to: by a hash that tells rows apart, or by their number. Then many is a scan of a written table, whose rows have the same numbers each time."""
    if hot is None:
        return many
    number = F.monotonically_increasing_id() if by is None else by
    return many.withColumn("_at", number).join(hot, on, "left").withColumn(part, F.coalesce(F.pmod("_at", F.col("_k")), F.lit(0)).cast("int")).drop("_at", "_k")


def met(many: DataFrame, one: DataFrame, hot: DataFrame | None, on: list[str], how: str = "inner", part: str = "_part") -> DataFrame:
    """many (of ``dealt``) joined with one, which has a row for each key at most and is sent to each part of a hot one."""
    if hot is None:
        return many.join(one, on, how)
    every = one.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k") - 1, F.lit(0))))).drop("_k")
    return many.join(every, [*on, part], how).drop(part)


def joined(many: DataFrame, one: DataFrame, on: list[str], sizes: DataFrame | None = None, total: int | None = None, how: str = "inner", by: Column | None = None) -> DataFrame:
    """many joined with one on the columns named on. one has at most one row for each key; keys of many rows are dealt to several tasks.

    sizes (on, _n) are many's rows by key, if they are known already. Null keys meet nothing.
    """
    if sizes is None:
        sizes = many.groupBy(*on).agg(F.count("*").alias("_n"))
    for c in on:
        sizes = sizes.filter(F.col(c).isNotNull())
    hot = hot_keys(sizes, many.count() if total is None else total)
    return met(dealt(many, hot, on, by=by), one, hot, on, how)
