"""Post-processing of raw blocks into features (element by element, or scaled by rows and columns)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likegraph.operators.frames import Blocks, FeatureFrame
from likegraph.workers import let_workers_import

Process = Callable[[Blocks], FeatureFrame]
#: Blocks of no greater weight are left out, with their columns.
LEAST = 1e-7
#: Columns of a block that go to each task: names and two numbers each, some 100 MB.
MOST_COLUMNS = 1_000_000


def combine(frames: list[tuple[FeatureFrame, float, str]]) -> FeatureFrame:
    """Frames side by side, each times its weight and under a block name of its own; those of weight 1e-7 or less are left out."""
    used = [(f, w, name) for f, w, name in frames if w > LEAST]
    if not used:
        raise ValueError("no features to combine")
    rows, alike, defaults = None, None, {}
    dense = any(f.alike is not None for f, _, _ in used)
    for f, w, name in used:
        block = F.when(F.col("block") == "", F.lit(name)).otherwise(F.concat(F.lit(f"{name}." if name else ""), F.col("block"))) if name else F.col("block")
        part = f.values.select("bodyid", block.alias("block"), "feature", (F.col("value") * w).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
        if dense:
            fewer = f.shifted().withColumn("against", F.lit(False)) if f.alike is None else f.alike
            fewer = fewer.select("bodyid", block.alias("block"), "feature", (F.col("value") * w).alias("value"), "against")
            alike = fewer if alike is None else alike.unionByName(fewer)
        defaults |= {(f"{name}.{b}" if name and b else name or b): v * w for b, v in f.defaults.items()}
    return FeatureFrame(used[0][0].bodies, rows, defaults, tuple(t for f, _, _ in used for t in f.held), alike)


def _each(function: Callable[[Column], Column], at_zero: float, wgt_in: float, wgt_out: float) -> Process:
    def run(raw: Blocks) -> FeatureFrame:
        parts = []
        for direction, weight in (("in", wgt_in), ("out", wgt_out)):
            rows = raw.values.filter(F.col("direction") == direction).select("bodyid", F.lit("").alias("block"), "feature", function(F.col("value")).alias("value"))
            parts.append((FeatureFrame(raw.bodies, rows, {"": at_zero} if at_zero else {}), weight, direction))
        return combine(parts)

    return run


def sigmoid_process(start: float = 10, stop: float = 30, wgt_in: float = 0.5, wgt_out: float = 0.5) -> Process:
    """1 / (1 + exp(-(x - shift) / scale)), half way between start and stop. Its value at 0 is every missing feature's."""
    shift, scale = (stop - start) / 2 + start, (stop - start) / 4
    return _each(lambda x: 1 / (1 + F.exp(-((x - shift) / scale))), 1 / (1 + math.exp(shift / scale)), wgt_in, wgt_out)


def piecewise_process(mid: float = 100, slope1: float = 1.0, slope2: float = 0.1, wgt_in: float = 0.5, wgt_out: float = 0.5) -> Process:
    """One slope below mid, another from there on."""
    return _each(lambda x: F.when(x < mid, x * slope1).otherwise(mid * slope1 + (x - mid) * slope2), 0.0 if mid > 0 else (mid * slope1 - mid * slope2), wgt_in, wgt_out)


def clipped_process(start: float = 3, stop: float = 50, wgt_in: float = 0.5, wgt_out: float = 0.5) -> Process:
    """0 below start, stop above stop, else the value, never cut to a whole number."""
    return _each(lambda x: F.when(x < start, F.lit(0.0)).when(x > stop, F.lit(float(stop))).otherwise(x), 0.0 if start > 0 or stop >= 0 else float(stop), wgt_in, wgt_out)


def noop_process(wgt_in: float, wgt_out: float) -> Process:
    return _each(lambda x: x * 1.0, 0.0, wgt_in, wgt_out)


def _by_row(rows: DataFrame) -> DataFrame:
    """Each body's values at length 1; a body of zeros stays."""
    norm = rows.groupBy("bodyid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return rows.join(norm, "bodyid").withColumn("value", F.coalesce(F.try_divide("value", F.col("_norm")), F.lit(0.0))).drop("_norm")


def _scores(bodies: DataFrame, share: DataFrame, spread: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(bodyid, block, feature, value): each body's z-scores in all columns of spread (block, feature, mean, std), at length 1; a body of zeros stays. And the frame's ``alike``.

    Every body has a row for each column, as zeros have scores too. The columns, if they are at most
    MOST_COLUMNS, go to each task, which makes a body's rows where it has its values: nothing dense is
    joined or shuffled. More are joined.
    """
    let_workers_import(bodies.sparkSession)
    columns = spread.withColumn("at", F.xxhash64("block", "feature")).orderBy("at").limit(MOST_COLUMNS + 1).toArrow()
    if columns.num_rows > MOST_COLUMNS:
        full = bodies.select("bodyid").crossJoin(spread).join(share, ["bodyid", "block", "feature"], "left")
        score = full.select("bodyid", "block", F.concat("feature", F.lit("-s")).alias("feature"), F.coalesce(F.try_divide(F.coalesce("value", F.lit(0.0)) - F.col("mean"), F.when(F.col("std") > 1e-15, F.col("std"))), F.lit(0.0)).alias("value"))
        return _by_row(score), None
    shared = bodies.sparkSession.sparkContext.broadcast([columns[c].to_pylist() for c in ("block", "feature", "at", "mean", "std")])
    held = share.groupBy("bodyid").agg(F.collect_list(F.struct(F.xxhash64("block", "feature").alias("at"), "value")).alias("v"))
    rows = bodies.select("bodyid").join(held, "bodyid", "left").select("bodyid", F.coalesce("v", F.array().cast("array<struct<at:bigint,value:double>>")).alias("v"))

    def made(batches, alike):
        block, feature, at, mean, std = shared.value
        names = [pa.array(block, pa.string()), pa.array([f"{f}-s" for f in feature], pa.string())]
        at, mean, std = np.array(at, dtype=np.int64), np.array(mean, dtype=float), np.array(std, dtype=float)
        scale = np.where(std > 1e-15, 1 / np.where(std > 1e-15, std, 1), 0.0)
        zero = mean * scale
        far = np.sqrt(zero @ zero)
        for batch in batches:
            for body, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.zeros(len(at))
                own = v.values
                places, given = np.searchsorted(at, own.field("at").to_numpy()), own.field("value").to_numpy()
                value[places] = given
                value = (value - mean) * scale
                length = np.sqrt(value @ value)
                if alike:
                    some = given * scale[places] / length if length else given * 0
                    order = np.argsort(places)  # equal bodies give equal sums
                    along = some[order] @ zero[places[order]] / far if far else 0.0
                    whole = along - (far / length if length else 0.0)
                    marks = [pa.concat_arrays([n.take(pa.array(places)), pa.array(["", ""], pa.string())]) for n in names]
                    marks[1] = pa.concat_arrays([marks[1].slice(0, len(places)), pa.array(["scores", "zeros"])])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places) + 2, body, dtype=np.int64)), *marks, pa.array(np.append(some, [whole, along])), pa.array(np.arange(len(places) + 2) > len(places))], ["bodyid", "block", "feature", "value", "against"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), body, dtype=np.int64)), *names, pa.array(value / length if length else value)], ["bodyid", "block", "feature", "value"])

    columns = "bodyid long, block string, feature string, value double"
    return rows.mapInArrow(lambda b: made(b, False), columns), rows.mapInArrow(lambda b: made(b, True), f"{columns}, against boolean")


def scaled_process(wgt_in: float = 1.0, wgt_out: float = 1.0, wgts: tuple[float, float, float] | list[float] = (0.8, 0.1, 0.1)) -> Process:
    """Three blocks: shares of each body's total, at length 1; the same by column z-scores (population deviation, zeros counted), at length 1; z-scores of the totals.

    The second block is dense (bodies x features) and is built only if its weight counts. A body without
    connections has shares of 0; a column without spread has scores of 0. The in-total's column is named
    post, the out-total's pre.
    """

    def run(raw: Blocks) -> FeatureFrame:
        bodies, sides = raw.bodies, {d: w for d, w in (("in", wgt_in), ("out", wgt_out)) if w > LEAST}
        if not sides:
            raise ValueError("no features to combine")
        weight = F.when(F.col("direction") == "in", F.lit(float(wgt_in))).otherwise(F.lit(float(wgt_out)))
        totals = raw.values.groupBy("bodyid", "direction").agg(F.sum("value").cast("double").alias("total"))
        share = raw.values.filter(F.col("direction").isin(*sides)).join(totals, ["bodyid", "direction"])
        share = share.select("bodyid", F.col("direction").alias("block"), "feature", (F.coalesce(F.try_divide("value", F.col("total")), F.lit(0.0)) * weight).alias("value"))
        parts = []
        if wgts[0] > LEAST:
            parts.append((FeatureFrame(bodies, _by_row(share)), wgts[0], "share"))
        if wgts[1] > LEAST:
            n = bodies.count()
            stats = share.groupBy("block", "feature").agg((F.sum("value") / n).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("sq"), F.count("*").alias("k"), F.avg("value").alias("own"), F.var_pop("value").alias("var"))
            # variance over all bodies from that of the stored values: exact for the zeros not stored
            spread = stats.select("block", "feature", "mean", F.sqrt((F.col("k") * F.col("var") + F.col("k") * (n - F.col("k")) / n * F.col("own") * F.col("own")) / n).alias("std"))
            scores, alike = _scores(bodies, share, spread)
            parts.append((FeatureFrame(bodies, scores, alike=alike), wgts[1], "scaled"))
        if wgts[2] > LEAST:
            named = F.when(F.col("direction") == "in", "post").otherwise("pre")
            sizes = None
            for d in sides:
                one = bodies.select("bodyid").join(totals.filter(F.col("direction") == d), "bodyid", "left").select("bodyid", F.lit(d).alias("direction"), (F.coalesce("total", F.lit(0.0)) * sides[d]).alias("value"))
                sizes = one if sizes is None else sizes.unionByName(one)
            stats = sizes.groupBy("direction").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
            score = sizes.join(F.broadcast(stats), "direction").select("bodyid", F.lit("").alias("block"), named.alias("feature"), F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.when(F.col("std") > 0, F.col("std"))), F.lit(0.0)).alias("value"))
            parts.append((FeatureFrame(bodies, score), wgts[2], "size"))
        return combine(parts) if parts else combine([])

    return run
