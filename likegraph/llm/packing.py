"""Best-fit packing: documents as token ids, cut into pieces, packed into as few sequences as best fit finds.

Best-fit decreasing over all pieces, not over each partition's: pieces of equal length are alike, so the
driver packs a histogram (at most ``capacity`` rows, at any input size) and each piece then takes its
place by its rank among those of its length. A segment tree over remaining capacities finds the tightest
open bin for a length in logarithmic time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likegraph.llm.shared import text_slices, written
from likegraph.llm.tokens import encoder
from likegraph.spread import joined
from likegraph.workers import trimmed

#: Rows of a plan that are broadcast; a longer plan is left to Spark's own choice of join.
MOST_BROADCAST = 200_000


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds runs of open bins alike: (first bin, bins)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, dtype=np.int64)  # runs below each node
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _add(self, leaf: int, n: int) -> None:
        at = self.size + leaf
        while at:
            self.open[at] += n
            at //= 2

    def push(self, left: int, first: int, bins: int) -> None:
        self.runs.setdefault(left, []).append((first, bins))
        self._add(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._add(left, -1)
        return self.runs[left].pop()

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is not under length."""
        at = self.size + length
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of so many pieces of each length (1..capacity).

    Rows (length, rank from, rank to, first bin, pieces in each bin, offset): the piece of that length
    and rank r in [from, to) stands in bin first + (r - from) // per, at offset + ((r - from) % per) * length.
    """
    tree, bins, plan = CapacityTree(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                per = min(capacity // length, todo)
                n, left, first = todo // per, capacity, bins
                bins += n
            else:
                first, n = tree.pop(left)
                per = min(left // length, todo)
                if n * per > todo:
                    used = todo // per
                    tree.push(left, first + used, n - used)
                    n = used
            plan.append((length, rank, rank + n * per, first, per, capacity - left))
            if left - per * length:
                tree.push(left - per * length, first, n)
            rank += n * per
            todo -= n * per
    return plan


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids with the end id, cut at multiples of capacity.

    Null text counts as empty; a null id stays null; equal ids stay apart as rows. Other columns are not
    read. Returns doc_id, piece, start, length, ids_crc32.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        coder = encoder(tokenizer, 500_000)
        for batch in batches:
            ids = batch.column(0)
            for a, _, texts in text_slices(batch.column(1), 2_000_000):
                flat, ends = coder.encode(texts)
                rows, start = [], 0
                for k, stop in enumerate(ends.tolist()):
                    whole = np.append(flat[start:stop], np.uint32(end_id)).astype("<u4")
                    rows += [(a + k, at // capacity, at, len(cut := whole[at : at + capacity]), zlib.crc32(cut)) for at in range(0, len(whole), capacity)]
                    start = stop
                at, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        coder.rest(60_000)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(trimmed(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(cuts: DataFrame, capacity: int = 2048) -> DataFrame:
    """cuts (with doc_id, piece, length in 1..capacity) with sequence_id and offset.

    Sequences are gapless from offset 0. Ties of one id and piece are ranked in any order, each with a
    place of its own. An empty table gives an empty one.
    """
    spark = cuts.sparkSession
    # Ranks within a length: a length may hold a third of all pieces, so they are counted by part of it.
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = written(cuts.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(parts)).cast("int")), "pieces")
    counts = cuts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    columns = np.array(best_fit_plan(histogram, capacity), dtype=np.int64).reshape(-1, 6).T
    # an Arrow table goes to the JVM as it is, with no Python worker between
    plan = spark.createDataFrame(pa.table(list(columns), names=["length", "_from", "_to", "_bin", "_per", "_at"]))
    ranked = cuts.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
    bases = counts.select("length", "_part", "_before")
    if len(histogram) * parts <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    ranked = ranked.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")
    if plan.count() <= MOST_BROADCAST:
        met = ranked.join(F.broadcast(plan), "length")
    else:  # a length may hold a third of all pieces
        met = joined(ranked, plan, ["length"], counts.groupBy("length").agg(F.sum("_n").alias("_n")), sum(histogram.values()), by=F.xxhash64("doc_id", "piece", "_rank"))
    placed = met.filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    r = F.col("_rank") - F.col("_from")
    return placed.select(
        *[c for c in cuts.columns if c != "_part"],
        (F.col("_bin") + F.floor(F.try_divide(r, F.col("_per"))).cast("long")).alias("sequence_id"),
        (F.col("_at") + F.pmod(r, F.col("_per")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **names) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is a document of the end id alone; null and equal ids stay apart as rows; documents longer than
    capacity are cut; pieces of equal length are placed in order of id and piece within a part; an empty table
    gives no rows; other columns are not read.
    """
    return packed(pieces(docs, tokenizer, capacity, end_id, **names), capacity)
