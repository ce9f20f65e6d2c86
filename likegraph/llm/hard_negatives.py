"""Hard negatives by inner products that end early.

Integer vectors are turned onto the principal axes of all rows, so that the leading components hold most of
a product. After some of them, what the rest can add is at most the product of the residual norms (and a
slack for rounding), so most pairs are known to be out of reach; the others' products are worked out in
integers. Anchors are taken in blocks that every task holds; each block is two scans of the rows, one that
finds its positives and one its negatives, and no row moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likegraph.llm.shared import drop_written, written
from likegraph.llm.vectors import rows_of, whole
from likegraph.workers import let_workers_import, trimmed

#: Anchors of a block, bytes of their vectors, anchors that meet a batch at once, and candidates that wait to be ranked.
ANCHORS, ANCHOR_BYTES, AT_ONCE, WAITING = 32_768, 32_000_000, 1024, 200_000
#: What rounding may be off, of the product of two norms.
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


def quantised(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each width the principal axes (columns) of all vectors (v array<long>): those of their products' sums, which tasks add up. The driver holds width^2 numbers."""

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            width = np.array(batch.column("d"))
            for d in np.unique(width):
                x = rows_of(batch.column("v").take(pa.array(np.flatnonzero(width == d)))).astype(np.float64)
                held[int(d)] = held.get(int(d), 0) + x.T @ x
        for d, m in held.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], ["d", "i", "j", "m"])

    got = vectors.select("d", "v").mapInArrow(trimmed(sums), "d int, i int, j int, m double").groupBy("d", "i", "j").agg(F.sum("m").alias("m")).toArrow()
    out = {}
    d, i, j, m = (got[c].to_numpy() for c in ("d", "i", "j", "m"))
    for w in np.unique(d).tolist():
        full = np.zeros((w, w))
        full[i[d == w], j[d == w]] = m[d == w]
        out[w] = np.linalg.eigh((full + full.T) / 2)[1][:, ::-1].copy()
    return out


class Turned:
    """Vectors of one width on the principal axes, with what is left of each after the leading components."""

    def __init__(self, v: np.ndarray, axes: np.ndarray):
        d = v.shape[1]
        self.v, self.y = v, v.astype(np.float64) @ axes
        self.stops = sorted({min(d, -(-d * k // 16)) for k in (1, 2, 4, 8)})
        squares = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(squares[:, 0])
        self.rest = [np.sqrt(squares[:, m]) if m < d else np.zeros(len(v)) for m in self.stops]


def survivors(a: Turned, p: np.ndarray, b: Turned, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of the places p in a, all of b; where allowed) whose product may lie between least and most of its anchor."""
    start, part, alive = 0, 0.0, allowed
    slack = SLACK * a.norm[p][:, None] * b.norm[None, :] + 1e-6
    for stop, ra, rb in zip(a.stops, a.rest, b.rest, strict=True):
        part = part + a.y[p, start:stop] @ b.y[:, start:stop].T
        off = ra[p][:, None] * rb[None, :] + slack
        alive = alive & (part + off >= least[:, None]) & (part - off <= most[:, None])
        start = stop
        if seen is not None:
            seen.append(int(alive.sum()))
        if not alive.any():
            break
    return np.nonzero(alive)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in integers. Products that 64 bits can't hold are an error."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] >= 2.0**62:
        raise OverflowError("inner products of more than 64 bits")
    return np.einsum("ij,ij->i", x, y)


class Best:
    """The first ``top`` of the candidates of each slot: by score, then id, then row. What is known to come after them is told by ``bar``."""

    def __init__(self, slots: int, top: int):
        self.top, self.bar = top, np.full(slots, _NONE)
        self.kept, self.waiting, self.many = [np.zeros(0, np.int64)] * 4, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        ok = score >= self.bar[slot]
        self.waiting.append([c[ok] for c in (slot, score, ids, rows)])
        self.many += int(ok.sum())
        if self.many > max(WAITING, len(self.kept[0])):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        if self.waiting:
            slot, score, ids, rows = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
            order = np.lexsort((rows, ids, -score, slot))
            slot = slot[order]
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
            rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
            use = order[rank < self.top]
            self.kept = [np.concatenate([k, *(w[j] for w in self.waiting)])[use] for j, k in enumerate(self.kept)]
            full = rank == self.top - 1
            self.bar[slot[full]] = score[order[full]]
            self.waiting, self.many = [], 0
        return self.kept


def _opened(rows: pa.Table | pa.RecordBatch, turn: dict[int, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray], Turned]]:
    """The rows by width."""
    width = np.array(rows["d"])
    for d in np.unique(width).tolist():
        of = rows.take(pa.array(np.flatnonzero(width == d)))
        v = of["v"].combine_chunks() if isinstance(of["v"], pa.ChunkedArray) else of["v"]
        yield d, {c: of[c].to_numpy() for c in ("r", "id", "label")}, Turned(rows_of(v), turn[d])


def _positives(held, turn, top: int):
    """Scan one: each anchor's best rows of its own label."""

    def run(batches):
        anchors = {d: (own, t) for d, own, t in _opened(held.value, turn.value)}
        best = {d: Best(len(own["r"]), top) for d, (own, _) in anchors.items()}
        for batch in batches:
            for d, other, b in _opened(batch, turn.value):
                if d not in anchors:
                    continue
                own, a = anchors[d]
                for label in np.intersect1d(own["label"], other["label"]):
                    q = np.flatnonzero(other["label"] == label)
                    part = Turned(b.v[q], turn.value[d])
                    of_label = np.flatnonzero(own["label"] == label)
                    for k in range(0, len(of_label), AT_ONCE):
                        p = of_label[k : k + AT_ONCE]
                        bar = best[d].bar[p]
                        i, j = survivors(a, p, part, own["r"][p][:, None] != other["r"][q][None, :], np.where(bar == _NONE, -np.inf, bar), np.full(len(p), np.inf))
                        best[d].add(p[i], products(a.v[p[i]], part.v[j]), other["id"][q[j]], other["r"][q[j]])
        for d, (own, _) in anchors.items():
            slot, score, ids, rows = best[d].settle()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own["r"][slot], own["id"][slot], score, ids, rows)], ["a", "anchor_id", "score", "id", "r"])

    return run


def _negatives(held, turn, goals, top: int, low: int, high: int):
    """Scan two: for each anchor and positive the best rows of other labels whose product lies between low and high hundredths of the positive's."""

    def run(batches):
        anchors = {}
        a_row, score, number = goals.value
        for d, own, t in _opened(held.value, turn.value):
            order = np.argsort(own["r"])
            place = np.searchsorted(own["r"][order], a_row)
            mine = np.flatnonzero((place < len(order)) & (own["r"][order][np.minimum(place, len(order) - 1)] == a_row))
            at, s, n = order[place[mine]], score[mine], number[mine]
            some = low * s <= high * s  # else nothing lies between
            by = np.argsort(at[some], kind="stable")
            at, s, n = (x[some][by] for x in (at, s, n))
            anchors[d] = own, t, at, s, n, Best(len(at), top), np.searchsorted(at, np.arange(len(own["r"]) + 1))
        for batch in batches:
            for d, other, b in _opened(batch, turn.value):
                if d not in anchors:
                    continue
                own, a, at, s, _, best, cut = anchors[d]
                floor, roof = np.ceil(low * s / 100) - 1, np.floor(high * s / 100) + 1
                least, most = np.full(len(own["r"]), np.inf), np.full(len(own["r"]), -np.inf)
                np.minimum.at(least, at, np.maximum(floor, np.where(best.bar == _NONE, -np.inf, best.bar)))
                np.maximum.at(most, at, roof)
                wanted = np.flatnonzero(least <= most)
                for k in range(0, len(wanted), AT_ONCE):
                    p = wanted[k : k + AT_ONCE]
                    i, j = survivors(a, p, b, own["label"][p][:, None] != other["label"][None, :], least[p], most[p])
                    for c in range(0, len(i), WAITING):
                        ii, jj = p[i[c : c + WAITING]], j[c : c + WAITING]
                        got = products(a.v[ii], b.v[jj])
                        times = cut[ii + 1] - cut[ii]
                        pair = np.repeat(np.arange(len(ii)), times)
                        goal = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(cut[ii], times)
                        ok = (low * s[goal] <= 100 * got[pair]) & (100 * got[pair] <= high * s[goal])
                        pair, goal = pair[ok], goal[ok]
                        best.add(goal, got[pair], other["id"][jj[pair]], other["r"][jj[pair]])
        for _, _, _, _, n, best, _ in anchors.values():
            slot, score_, ids, rows = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n[slot], score_, ids, rows)], ["goal", "score", "id", "r"])

    return run


def _first(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    """The first of each group, of the few that each task has passed on, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "r")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), of vectors of 256ths.

    Anchors are the rows whose id is divisible by ``every``; their positives the ``positives`` other rows of
    the same label of the greatest products; their negatives, for each positive, the first ``negatives`` rows of
    another label whose product is at least low and at most high hundredths of the positive's. Equal products go by id.

    Rows without an id or a label, and vectors that are null, empty or hold null or non-finite components,
    take no part; vectors meet those of their own length only. Rows that share an id are rows of their own.
    An anchor without a positive, and a positive without a negative, have no row; an empty table gives an empty one.
    Other columns are not read.
    """
    spark = rows.sparkSession
    let_workers_import(spark)
    plain = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole("v"))
    vectors = written(plain.withColumns({"r": F.monotonically_increasing_id(), "d": F.size("v"), "v": quantised("v")}), "vectors")
    anchors = vectors.filter(F.col("id") % every == 0)
    told = anchors.agg(F.count("*"), F.max("d")).first()
    turn = spark.sparkContext.broadcast(axes(vectors))
    blocks = -(-told[0] // min(ANCHORS, max(1, ANCHOR_BYTES // (8 * (told[1] or 1)))))
    out = None
    for k in range(max(blocks, 1)):
        held = spark.sparkContext.broadcast(anchors.filter(F.pmod(F.xxhash64("r"), F.lit(max(blocks, 1))) == k).toArrow().combine_chunks())
        near = vectors.select("r", "id", "label", "d", "v").mapInArrow(trimmed(_positives(held, turn, positives)), "a long, anchor_id long, score long, id long, r long")
        best = written(_first(near, ["a"], positives).withColumn("goal", F.monotonically_increasing_id()), "positives")
        few = best.select("a", "score", "goal").toArrow()  # at most ``positives`` for each anchor of the block
        goals = spark.sparkContext.broadcast([few[c].to_numpy() for c in ("a", "score", "goal")])
        far = vectors.select("r", "id", "label", "d", "v").mapInArrow(trimmed(_negatives(held, turn, goals, negatives, low, high)), "goal long, score long, id long, r long")
        hard = _first(far, ["goal"], negatives).select("goal", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = written(hard.join(best.select("goal", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "goal"), "negatives")
        drop_written(best)
        part = part.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = part if out is None else out.unionByName(part)
        held.unpersist()
        goals.unpersist()
    drop_written(vectors)
    return out
