"""Near-duplicate vectors by binary codes of a random rotation.

A unit vector o, rotated at random, is coded as its signs: the corner x of a cube that is nearest to it, one
bit a component. <x, q> / <x, o> is an unbiased estimate of <o, q> for any unit q, and its error is known:
what x has beside o points anywhere, so the estimate is off by sqrt(1 - f^2) / f * sqrt(1 - <o, q>^2) times a
coordinate of a random direction, where f = <x, o> is the code's stored correction. q itself is coded in four
bits a component, rounded at random, so estimates are sums over bit planes. Pairs whose estimate, with the
error that is allowed, stays below the threshold are done with; the others' cosines are worked out exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likegraph.llm.components import connected_components
from likegraph.llm.shared import drop_written, written
from likegraph.llm.vectors import block_pairs, blocks, rows_of, whole
from likegraph.spread import joined
from likegraph.workers import let_workers_import, trimmed

#: Vectors in a block, bits of a component of the other side, standard errors that an estimate may be off.
BLOCK, LEVELS, ERRORS = 1024, 15, 7.0
#: Vectors that a bucket should hold, and most bits of a bucket's key.
BUCKET, MOST_BITS = 8192, 24
SEED = 20


def rotation(width: int) -> np.ndarray:
    """An orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, width)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def planes(width: int, tables: int, bits: int) -> np.ndarray:
    """Directions whose signs are the keys of a vector: bits of them for each table."""
    return np.random.default_rng((SEED + 1, width, bits)).standard_normal((width, tables * bits))


def tables_for(bits: int, cosine: float, miss: float) -> int:
    """Tables after which a pair at the cosine has shared none of its keys with at most the probability miss."""
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if not bits else math.ceil(math.log(miss) / math.log1p(-meet))


def code(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """For each unit vector: sign bits and the four bit planes of its rounded components, as words; correction, least component and step."""
    n, d = vectors.shape
    words = -(-d // 64)
    y = vectors @ rotation(d)
    pack = lambda b: np.ascontiguousarray(np.pad(np.packbits(b, axis=1, bitorder="little"), ((0, 0), (0, words * 8 - -(-d // 8))))).view(np.uint64)
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / LEVELS, 1e-300)
    level = np.clip(np.floor((y - low[:, None]) / step[:, None] + np.random.default_rng(SEED).random((1, d))), 0, LEVELS).astype(np.uint8)
    return {
        "signs": pack(y > 0),
        "planes": np.stack([pack((level >> k) & 1) for k in range(4)], axis=1),
        "f": np.abs(y).sum(axis=1) / math.sqrt(d),
        "low": low,
        "step": step,
        "sum": level.sum(axis=1, dtype=np.int64),
    }


def estimate(x: dict[str, np.ndarray], y: dict[str, np.ndarray], d: int) -> np.ndarray:
    """Unbiased estimates of the inner products of x's vectors, by their signs, with y's, by their levels."""
    ones = np.bitwise_count(x["signs"]).sum(axis=1, dtype=np.int64)
    dots = np.zeros((len(ones), len(y["low"])), dtype=np.float64)
    for k in range(4):
        for w in range(x["signs"].shape[1]):
            dots += np.bitwise_count(x["signs"][:, None, w] & y["planes"][None, :, k, w]) * float(1 << k)
    sums = 2 * (y["step"] * dots + y["low"] * ones[:, None]) - y["step"] * y["sum"] - y["low"] * d
    return sums / (math.sqrt(d) * x["f"][:, None])


def least_estimate(x: dict[str, np.ndarray], y: dict[str, np.ndarray], d: int, cosine: float) -> np.ndarray:
    """What an estimate is at the least, but for ERRORS standard errors, if the inner product is the cosine or more.

    The allowed error is largest at the cosine itself. Vectors of few components have no known error.
    """
    if d < 16:
        return np.full((len(x["f"]), len(y["low"])), -np.inf)
    off = np.sqrt(np.maximum(1 / x["f"] ** 2 - 1, 0) * (1 - cosine**2) / (d - 1))[:, None]
    rounding = y["step"][None, :] / (2 * x["f"][:, None])
    return cosine - ERRORS * np.sqrt(off**2 + rounding**2) - 1e-9


#: A code as columns: what rows carry from block to block.
_CODE = ("signs", "planes", "f", "low", "step", "sum")
_CODE_SCHEMA = "signs binary, planes binary, f double, low double, step double, sum long"


def _columns(c: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.tobytes() for x in c[k]], pa.binary()) if k in _CODE[:2] else pa.array(c[k]) for k in _CODE]


def _opened(rows: pa.StructArray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Rows of a block, and their codes."""
    v = rows_of(rows.field("v")).astype(np.float64)
    words = lambda k, *shape: np.frombuffer(b"".join(rows.field(k).to_pylist()), np.uint64).reshape(len(v), *shape, -1)
    stored = {"signs": words("signs"), "planes": words("planes", 4)} | {k: np.array(rows.field(k)) for k in _CODE[2:]}
    return {"c": np.array(rows.field("c")), "n": np.array(rows.field("n")), "v": v, "norm": np.sqrt(np.einsum("ij,ij->i", v, v)), "keys": rows_of(rows.field("keys"))}, stored


def _meet(cosine: float):
    """For each two blocks: (a, b, n) where b, linked with a, makes a forest of their links, and (a, null, n) for the rows linked with a."""

    def run(a, b, same):
        x, cx = _opened(a)
        y, cy = (x, cx) if same else _opened(b)
        d = x["v"].shape[1]
        table = int(rows_of(a.field("table"))[0, 0])
        links_x, links_y = np.zeros(len(x["c"]), np.int64), np.zeros(len(y["c"]), np.int64)
        forest = _Forest()
        for i in range(0, len(x["c"]), 256):
            part = {k: v[i : i + 256] for k, v in cx.items()}
            may = estimate(part, cy, d) >= least_estimate(part, cy, d, cosine)
            if same:
                may &= np.arange(i, i + len(may))[:, None] < np.arange(len(y["c"]))[None, :]
            p, q = np.nonzero(may)
            p += i
            for j in range(0, len(p), 1 << 15):
                pp, qq = p[j : j + (1 << 15)], q[j : j + (1 << 15)]
                ok = np.einsum("ij,ij->i", x["v"][pp], y["v"][qq]) >= cosine * (x["norm"][pp] * y["norm"][qq])
                if table:  # a pair that met in an earlier table counts there
                    ok &= ~(x["keys"][pp, :table] == y["keys"][qq, :table]).any(axis=1)
                pp, qq = pp[ok], qq[ok]
                links_x += np.bincount(pp, weights=y["n"][qq], minlength=len(links_x)).astype(np.int64)
                links_y += np.bincount(qq, weights=x["n"][pp], minlength=len(links_y)).astype(np.int64)
                forest.add(x["c"][pp], y["c"][qq])
        ends = forest.links()
        told = [(x["c"][links_x > 0], links_x[links_x > 0]), (y["c"][links_y > 0], links_y[links_y > 0])]
        for c, n in told:
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(n)], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64()), pa.nulls(len(ends), pa.int64())], ["a", "b", "n"])

    return run


class _Forest:
    """Links that join what was apart."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def top(self, k: int) -> int:
        while (u := self.up.setdefault(k, k)) != k:
            self.up[k] = self.up[u]
            k = u
        return k

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.top(p), self.top(q)
            if r != s:
                self.up[r] = s
                self.kept.append((p, q))

    def links(self) -> list[tuple[int, int]]:
        return self.kept


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, miss: float = 1e-6, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: how many others of its label have a cosine of at least ``cosine``, and the least id reachable by such links.

    Equal vectors of a label are one class that counts its rows. Classes of a label (and length) meet in
    blocks: all of them, or, where a label has more than ``bucket``, those that share a key of sign bits in
    one of so many tables that a pair at the cosine shares none with a probability below ``miss``. Codes decide which
    pairs are worked out in double precision; a pair is dropped unseen if its estimate would have to be
    seven standard errors off.

    Rows without a label, and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths neither. Rows that share an id, or have none, are rows of
    their own; null counts as greater than all ids. Other columns are not read; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    let_workers_import(spark)
    v = F.col("v")
    plain = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    usable = F.col("label").isNotNull() & whole("v") & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    keys = ["label", "h1", "h2"]
    marked = plain.withColumns({"ok": usable, "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    grouped = marked.filter("ok").groupBy(*keys).agg(F.first("v").alias("v"), F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = written(grouped.withColumns({"c": F.monotonically_increasing_id(), "d": F.size("v")}), "classes")
    sizes = written(classes.groupBy("label", "d").agg(F.count("*").alias("_n")), "sizes")
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / bucket)).cast("int")))
    coded = joined(classes.select("c", "n", "label", "d", "v"), sizes.select("label", "d", bits.alias("bits")), ["label", "d"], sizes)

    held = ["c", "n", "label", "d", "v"]

    def keyed(batches):
        for batch in batches:
            b, d = (np.array(batch.column(k)) for k in ("bits", "d"))
            for kb, kd in sorted({*zip(b.tolist(), d.tolist(), strict=True)}):
                at = np.flatnonzero((b == kb) & (d == kd))
                rows = batch.take(pa.array(at))
                x = rows_of(rows.column("v")).astype(np.float64)
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                t = tables_for(kb, cosine, miss)
                signs = (x @ planes(kd, t, kb) > 0).reshape(len(at), t, kb)
                keys = (signs * (1 << np.arange(kb))).sum(axis=2).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * t, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in held), keys, *_columns(code(x))], [*held, "keys", *_CODE])

    types = {k: coded.schema[k].dataType.simpleString() for k in ("label", "v")}
    coded = written(coded.mapInArrow(trimmed(keyed), f"c long, n long, label {types['label']}, d int, v {types['v']}, keys array<int>, {_CODE_SCHEMA}"), "coded")
    by = ["label", "d", "t", "key"]
    placed = coded.select("*", F.posexplode("keys").alias("t", "key")).withColumn("table", F.array("t"))
    met = written(block_pairs(blocks(placed, by, BLOCK, "c"), by, ["c", "n", "v", "keys", "table", *_CODE], _meet(cosine), "a long, b long, n long"), "met")
    counts = met.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    links = written(met.filter("b is not null").select("a", "b"), "forest")
    roots = connected_components(links)
    named = classes.select("c", *keys, "id", "n").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").join(counts, "c", "left")
    named = written(named.withColumn("root", F.coalesce("root", "c")), "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = joined(named, least, ["root"]).select(*keys, "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    of_class = written(of_class, "of_class")
    drop_written(coded, met, links, roots, named, sizes)
    linked = joined(marked.filter("ok").select("vec_id", *keys), of_class, keys, classes.select(*keys, F.col("n").alias("_n")))
    alone = marked.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
