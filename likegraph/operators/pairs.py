"""Pairs of bodies, block by block: what needs every pair is done inside a pair of blocks, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likegraph.spread import joined

#: Bodies of a side that meet at once, and bodies in a block at the least; a task holds two blocks.
BLOCK, SMALL = 1024, 64
#: Blocks of a group, where their values fit: a block is sent to each other, so bodies are sent about so many times, however many they are.
PARTS = 12
#: Stored values of a block, about, and columns that are made dense at once.
VALUES, COLUMNS = 1_000_000, 4096
#: Columns of lesser numbers (a few) count against dot products and squared lengths.
AGAINST = -(2**63) + 2**20


def block_size(many: int, values: int = 0) -> int:
    """Large enough that a block moves only to few others, small enough for some hundred pairs of blocks; fewer bodies where they have many stored values (of all bodies together)."""
    return max(1, min(BLOCK, max(SMALL, -(-many // 16)), VALUES * many // max(values, 1)))


def part_size(many: int, values: int = 0) -> int:
    """Bodies of a block that is sent to others: a twelfth of all, fewer where these have many stored values. Within a task they meet ``BLOCK`` by ``BLOCK``."""
    return max(1, min(max(SMALL, -(-many // PARTS)), VALUES * many // max(values, 1)))


@dataclass
class Rows:
    """Sparse rows: where each begins among the values, their columns (ascending in each row) and values."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def owner(self) -> np.ndarray:
        """The row of each value."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def norms(self, whole: bool = False) -> np.ndarray:
        """Squared lengths; whole: as if nothing counted against them."""
        square = self.values**2
        return np.bincount(self.owner(), weights=square if whole else np.where(self.columns < AGAINST, -square, square), minlength=len(self))

    def dense(self, columns: np.ndarray):
        """The rows over columns (ascending), some thousand of these at a time."""
        at = np.minimum(np.searchsorted(columns, self.columns), max(len(columns) - 1, 0))
        use = np.flatnonzero(columns[at] == self.columns) if len(columns) else np.zeros(0, np.int64)
        use = use[np.argsort(at[use], kind="stable")]
        at, owner, values = at[use], self.owner()[use], self.values[use]
        cuts = np.searchsorted(at, np.arange(0, len(columns) + COLUMNS, COLUMNS))
        for k, (start, stop) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out = np.zeros((len(self), min(COLUMNS, len(columns) - k * COLUMNS)))
            out[owner[start:stop], at[start:stop] - k * COLUMNS] = values[start:stop]
            yield out


def of_matrix(x: np.ndarray) -> Rows:
    return Rows(np.arange(len(x) + 1) * x.shape[1], np.tile(np.arange(x.shape[1]), len(x)), x.ravel())


@dataclass
class Side:
    """The bodies of a block: ids, positions, vectors, and further columns by name."""

    ids: np.ndarray
    pos: np.ndarray
    vectors: Rows
    more: dict[str, np.ndarray]

    def taken(self, at: np.ndarray) -> Side:
        sizes = np.diff(self.vectors.starts)[at]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        use = np.arange(starts[-1]) + np.repeat(self.vectors.starts[at] - starts[:-1], sizes)
        return Side(self.ids[at], self.pos[at], Rows(starts, self.vectors.columns[use], self.vectors.values[use]), {c: v[at] for c, v in self.more.items()})

    def pieces(self, most: int) -> list[Side]:
        """At most so many bodies each, in order of pos."""
        if len(self.ids) <= most:
            return [self]
        order = np.argsort(self.pos, kind="stable")
        return [self.taken(order[k : k + most]) for k in range(0, len(order), most)]

    def by(self, column: str) -> dict[int, Side]:
        """The bodies of each value of a further column."""
        order = np.argsort(self.more[column], kind="stable")
        names, starts = np.unique(self.more[column][order], return_index=True)
        return {int(n): self.taken(at) for n, at in zip(names, np.split(order, starts[1:]), strict=True)}


def first_of(*keys: Callable[[list[np.ndarray]], np.ndarray]) -> Callable[[list[list[np.ndarray]]], list[np.ndarray]]:
    """Of the rows that one task has found, the first of each value of the first key, in order of the others."""

    def run(found):
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.lexsort([k(columns) for k in reversed(keys)])
        name = keys[0](columns)[order]
        return [c[order[np.append(True, name[1:] != name[:-1])]] for c in columns] if len(order) else columns

    return run


def _apart(dots: np.ndarray, nx: np.ndarray, ny: np.ndarray, whole: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Squared distances from dot products and squared lengths. What rounding leaves of equal rows (of whole squared lengths, if these are others) is no distance."""
    sums = nx[:, None] + ny[None, :]
    out = sums - 2 * dots
    return np.where(out < 1e-13 * (sums if whole is None else whole[0][:, None] + whole[1][None, :]), 0.0, out)


def squares(x: Rows, y: Rows) -> np.ndarray:
    """Squared distances between rows, from dot products over the columns that both sides have, some thousand at a time."""
    shared = np.intersect1d(x.columns, y.columns)
    dots, against = np.zeros((len(x), len(y))), int(np.searchsorted(shared, AGAINST))
    for k, (p, q) in enumerate(zip(x.dense(shared), y.dense(shared), strict=True)):
        if k == 0:
            p[:, :against] *= -1
        dots += p @ q.T
    return _apart(dots, x.norms(), y.norms(), (x.norms(True), y.norms(True)))


def dense_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of matrices."""
    return _apart(x @ y.T, np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y))


def blocks_of(rows: DataFrame, many: int, values: int = 0) -> DataFrame:
    """rows (many of them, with pos from 0, and so many stored values together) with grp, blk and last: blocks of neighbours in pos."""
    size = part_size(many, values)
    return rows.withColumns({"grp": F.lit(""), "blk": F.floor(F.col("pos") / size).cast("int"), "last": F.lit(max(0, -(-many // size) - 1))})


def blocks_within(rows: DataFrame, labels: DataFrame, each: int = 0) -> DataFrame:
    """rows (bodyid; of so many stored values each) in the groups of labels (bodyid, grp), with grp, blk and last. Groups of any size are dealt to blocks by a hash; rows without a group go."""
    labels = labels.filter("grp is not null")
    sizes = labels.groupBy("grp").agg(F.count("*").alias("_n"))
    # as many blocks as ``part_size`` gives, and not fewer than the values need
    least, small = F.ceil(F.col("_n") * max(each, 1) / VALUES), F.ceil(F.col("_n") / min(256, max(1, VALUES // max(each, 1))))
    parts = sizes.select("grp", (F.greatest(least, F.least(small, F.lit(PARTS)), F.lit(1)).cast("int") - 1).alias("last"))
    placed = joined(labels, parts, ["grp"], sizes, labels.count(), by=F.xxhash64("bodyid"))
    return rows.join(placed.withColumn("blk", F.pmod(F.xxhash64("bodyid", F.lit(5)), F.col("last") + 1).cast("int")), "bodyid")


def each_pair(rows: DataFrame, function: Callable[[Side, Side, bool], list], schema: str, names: list[str], more: tuple[str, ...] = (), wanted: DataFrame | None = None, per: int = 1, most: int | None = None, whole: Callable[[list], list] | None = None) -> DataFrame:
    """What function(x, y, same) yields, as record batches of the columns names, for each two blocks of a group, and for each block with itself; or for the wanted (i, j) of one group alone.

    rows have bodyid, pos, at, of (hashed columns and values), grp, blk, last and more. A block is sent once
    for each other of its group, under a key of that pair's own, so no task has more than it can hold. There
    its bodies meet the other's in pieces of at most ``most``, in order of pos. Wanted blocks are sent ``per``
    at a time, and each meets those that it is wanted with. whole makes one result of all that a pair has found.
    """
    most, chosen = most or BLOCK, wanted is not None
    if not chosen:
        one = F.struct("bodyid", "pos", "at", "of", *more)
        blocks = rows.groupBy("grp", "blk", "last").agg(F.collect_list(one).alias("rows"))
        x = blocks.select("grp", F.col("blk").alias("i"), F.explode(F.sequence("blk", "last")).alias("j"), F.col("rows").alias("x"))
        y = blocks.select("grp", F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"), F.col("rows").alias("y"))
        both = x.join(y, ["grp", "i", "j"]).select("i", "j", "x", "y", F.array().cast("array<struct<i:int,j:int>>").alias("meet"))
    else:
        if "blk" not in more:
            more = (*more, "blk")
        one = F.struct("bodyid", "pos", "at", "of", *more)
        part = lambda c: F.floor(F.col(c) / per).cast("int")
        blocks = rows.groupBy(part("blk").alias("part")).agg(F.collect_list(one).alias("rows"))
        pairs = wanted.groupBy(part("i").alias("I"), part("j").alias("J")).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))).alias("meet"))
        x = pairs.join(blocks.select(F.col("part").alias("I"), F.col("rows").alias("x")), "I")
        both = x.join(blocks.select(F.col("part").alias("J"), F.col("rows").alias("y")), "J").select(F.col("I").alias("i"), F.col("J").alias("j"), "x", "y", "meet")

    def side(rows):
        starts = rows.field("at").offsets.to_numpy()
        vectors = Rows(starts - starts[0], rows.field("at").flatten().to_numpy(), rows.field("of").flatten().to_numpy())
        return Side(np.array(rows.field("bodyid")), np.array(rows.field("pos"), dtype=np.int64), vectors, {c: np.array(rows.field(c)) for c in more})

    def met(x, y, same, meet):
        """The pieces that meet."""
        if chosen:
            a, b = x.by("blk"), y.by("blk")
            for m in meet:
                yield a[m["i"]], b[m["j"]], m["i"] == m["j"]
            return
        a = x.pieces(most)
        b = a if same else y.pieces(most)
        for p, u in enumerate(a):
            for q in range(p if same else 0, len(b)):
                yield u, b[q], same and p == q

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (pa.concat_arrays([batch.column(c)[k].values]) for c in "xy")
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                found = (got for u, v, one in met(side(a), side(b), same, batch.column("meet")[k].as_py()) for got in function(u, v, one))
                if whole is not None:
                    found = list(found)
                    found = [whole(found)] if found else []
                for got in found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names)

    return both.mapInArrow(run, schema)


def nearest_in_pair(distance: Callable[[Side, Side], np.ndarray]) -> Callable:
    """For each body of either block the nearest of the other: bodyid, dist, lo and hi (positions of the two), other. Equal distances go by lo, then hi."""

    def best(x, y, d, same):
        p, q, none = x.pos.astype(np.int64)[:, None], y.pos.astype(np.int64)[None, :], np.int64(np.iinfo(np.int64).max)
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        if same:
            d = np.where(lo == hi, np.inf, d)
        least = d.min(axis=1)
        tied = d == least[:, None]
        first = np.where(tied, lo, none).min(axis=1)
        k = np.where(tied & (lo == first[:, None]), hi, none).argmin(axis=1)
        ok = np.isfinite(least)
        at = np.arange(len(k))
        return [c[ok] for c in (x.ids, least, lo[at, k].astype(np.int64), hi[at, k].astype(np.int64), y.ids[k])]

    def run(x, y, same):
        if same and len(x.ids) < 2:
            return
        d = distance(x, y)
        if same:
            d = np.triu(d, 1) + np.triu(d, 1).T
        yield best(x, y, d, same)
        if not same:
            yield best(y, x, d.T, same)

    return run


#: One row a body and pair of blocks.
NEAREST = first_of(*(lambda c, k=k: c[k] for k in range(4)))


def nearest(rows: DataFrame, distance: Callable[[Side, Side], np.ndarray], more: tuple[str, ...] = ()) -> DataFrame:
    """(bodyid, dist, lo, hi, other): each body's nearest, one row from each pair of blocks and then the best of them."""
    near = each_pair(rows, nearest_in_pair(distance), "bodyid long, dist double, lo long, hi long, other long", ["bodyid", "dist", "lo", "hi", "other"], more, whole=NEAREST)
    return near.groupBy("bodyid").agg(F.min(F.struct("dist", "lo", "hi", "other")).alias("b")).select("bodyid", "b.*")
