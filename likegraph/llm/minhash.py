"""Near-duplicates: MinHash bands for candidates, sequential Bayesian pruning on signatures, exact check of survivors.

Documents of equal shingle sets are one class, and only classes are compared. In a bucket of a band each class
is first compared with one pivot, so a group of near copies falls together by about as many pairs as it has
members. Buckets that still span several components are then compared in full, but only between components,
in blocks of bounded size that pass on nothing but survivors.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likegraph.llm.components import connected_components
from likegraph.llm.shared import drop_written, text_slices, written
from likegraph.llm.shingles import mix, shingle_sets
from likegraph.spread import dealt, hot_keys, joined, met
from likegraph.workers import trimmed

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Hashes compared at a time.
BATCH = 48
#: Classes in a block, when buckets are compared in full.
BLOCK = 256
#: Documents whose ids are broadcast to filter a scan; more are joined by a shuffle.
MOST_BROADCAST = 500_000

_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set of 64-bit shingles."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        part = low[i : i + 4096, None]
        np.minimum(out, (part * _A + _B).min(axis=0), out=out)
    return out


def kept_bytes(sig: np.ndarray) -> np.ndarray:
    """A byte of each hash of a signature, uniform whatever the size of the set: least values of large sets have like top bytes."""
    return (mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def fewest_matches(threshold: float, miss: float = 1e-6, values: int = 256) -> list[tuple[int, int]]:
    """(hashes compared, matches) after each batch: with fewer matches, the posterior probability that the similarity reaches threshold is under miss.

    Uniform prior over similarities s; a kept byte matches with probability s + (1 - s) / values.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / values
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p) + lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                break
        out.append((n, m))
    return out


def survive(a: np.ndarray, b: np.ndarray, fewest: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of the byte signatures a and b stay, comparing batch by batch only those that are left."""
    live, seen, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for n, least in fewest:
        seen[live] += (a[live, done:n] == b[live, done:n]).sum(axis=1, dtype=np.int32)
        live, done = live[seen[live] >= least], n
    return live


def _signed(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (shingles), h1 and h2 (which tell sets apart), bands, sig (a byte of each hash)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), 1_000_000):
                flat, sizes = shingle_sets(texts, k)
                ends, h1, h2, bands, sigs = np.cumsum(sizes), [], [], [], []
                for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                    own = flat[e - n : e]
                    h1.append(int(own.sum(dtype=np.uint64).view(np.int64)) if n else None)
                    h2.append(int(mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if n else None)
                    if not n:
                        bands.append(None)
                        sigs.append(None)
                        continue
                    sig = signature(own)
                    rows = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        rows = mix(rows * np.uint64(0x9E3779B97F4A7C15) + sig[r::ROWS][:BANDS])
                    bands.append(rows.view(np.int64))
                    sigs.append(kept_bytes(sig).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n", "h1", "h2", "bands", "sig"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(trimmed(run), f"doc_id {kind}, n long, h1 long, h2 long, bands array<long>, sig binary")


def _pruned(pairs: DataFrame, fewest: list[tuple[int, int]]) -> DataFrame:
    """The rows of pairs (a, b, sig_a, sig_b) that the signatures leave."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            at = pa.array(survive(x, y, fewest))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return pairs.mapInArrow(trimmed(run), "a long, b long")


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for the hash of each shingle, in 16 to 32 times as many bits, a power of two."""
    bits = max(64, 16 << (len(shingles) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(shingles >> np.uint64(20)).astype(np.int64) & bits - 1] = 1
    return np.packbits(out, bitorder="little").tobytes()


def most_alike(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int], num: int, den: int) -> np.ndarray:
    """Which rows may reach den * intersection >= num * union, by bitmaps (64-bit words) and set sizes. None that does is left out.

    A bit of one alone is a shingle at least that the other lacks, which bounds the intersection.
    """
    (x, nx), (y, ny) = a, b
    while x.shape[1] > y.shape[1]:  # bits are low bits of the hash, so halves fold onto each other
        x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
    same = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return den * same >= num * (nx + ny - same)


def _sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(cid, shingles, bits) of the classes in cids, from the text of one document of each."""
    wanted = written(cids.select("cid").distinct().join(classes.select("cid", "rep", "h1", "h2"), "cid"), "wanted")
    ids = wanted.select("rep").distinct()
    if wanted.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)

    def run(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), 1_000_000):
                flat, sizes = shingle_sets(texts, k)
                ends = np.cumsum(sizes).tolist()
                own = [flat[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True) if n]
                h1, h2 = ([int(f(o).sum(dtype=np.uint64).view(np.int64)) for o in own] for f in (lambda o: o, lambda o: mix(o + np.uint64(1))))
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([o.tobytes() for o in own], pa.binary()), pa.array([bitmap(o) for o in own], pa.binary())], ["h1", "h2", "shingles", "bits"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = written(texts.mapInArrow(trimmed(run), "h1 long, h2 long, shingles binary, bits binary").join(wanted, ["h1", "h2"]).select("cid", "shingles", "bits").dropDuplicates(["cid"]), "sets")
    drop_written(wanted)
    return sets


def _exact(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b of classes; a written table) whose sets have den * intersection >= num * union."""
    total = pairs.count()
    hot = [hot_keys(pairs.groupBy(x).agg(F.count("*").alias("_n")), total) for x in "ab"]
    both = dealt(dealt(pairs, hot[0], ["a"], "_pa"), hot[1], ["b"], "_pb")
    for x, h in zip("ab", hot, strict=True):
        both = met(both, sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"s{x}")), h, [x], part=f"_p{x}")

    def check(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("sa", "sb"))
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    short, long = (x, y) if len(x) < len(y) else (y, x)
                    at = np.searchsorted(long, short)
                    same = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                    if den * same >= num * (len(x) + len(y) - same):
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return written(both.select("sa", "sb", "a", "b").mapInArrow(trimmed(check), "a long, b long"), "exact")


def _between(members: DataFrame, classes: DataFrame, tried: DataFrame, fewest: list[tuple[int, int]], num: int, den: int) -> DataFrame:
    """Pairs of members (key, cid, root; a written table) of one bucket and of different roots that neither signatures nor bitmaps rule out, less those tried.

    Members of a bucket stand in blocks of bounded size: those of a root that has many there among
    themselves, all others mixed. Two blocks that may hold different roots are a row, with a key of its own.
    A pair that shares several buckets counts in the first.
    """
    per_root = written(members.groupBy("key", "root").agg(F.count("*").alias("_n")), "roots")
    rest = per_root.groupBy("key").agg(F.sum(F.when(F.col("_n") < BLOCK, F.col("_n")).otherwise(0)).alias("rest"))
    # blocks are named by root (-1: mixed) and number
    parts = per_root.join(rest, "key").select("key", "root", F.when(F.col("_n") < BLOCK, F.lit(-1).cast("long")).otherwise(F.col("root")).alias("of_root"), F.greatest(F.ceil(F.when(F.col("_n") < BLOCK, F.col("rest")).otherwise(F.col("_n")) / BLOCK), F.lit(1)).alias("parts"))
    placed = joined(members, parts, ["key", "root"], per_root, members.count())
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.when(F.col("of_root") < 0, F.col("root")).otherwise(F.col("cid"))), F.col("parts"))).select("key", "cid", "root", "of_root", "part")
    placed = written(placed, "placed")
    names = placed.groupBy("key", "of_root", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    names = written(names.withColumns({"i": F.row_number().over(Window.partitionBy("key").orderBy("of_root", "part")), "last": F.count("*").over(Window.partitionBy("key"))}), "names")
    others = names.select("key", F.col("i").alias("j"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    wanted = names.select("key", "i", "lo", "hi", F.explode(F.sequence("i", F.col("last").cast("int"))).alias("j")).join(others, ["key", "j"]).filter("not (lo = hi and lo_y = hi_y and lo = lo_y)").select("key", "i", "j")
    one = F.struct("cid", "root", "n", "sig", "bands", "bits")
    blocks = placed.join(classes, "cid").join(names.select("key", "of_root", "part", "i"), ["key", "of_root", "part"]).groupBy("key", "i").agg(F.collect_list(one).alias("of"))
    blocks = written(blocks, "blocks")
    met_ = wanted.join(blocks.withColumnRenamed("of", "of_x"), ["key", "i"]).join(blocks.select("key", F.col("i").alias("j"), F.col("of").alias("of_y")), ["key", "j"]).select("key", "of_x", "of_y")

    def opened(rows):
        raw = [np.frombuffer(v, np.uint64) for v in rows.field("bits").to_pylist()]
        ints = [np.array(rows.field(c)) for c in ("cid", "root", "n")]
        return *ints, np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(-1, HASHES), np.array(rows.field("bands").flatten()).reshape(-1, BANDS), raw, np.array([len(r) for r in raw])

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("key")[i].as_py()
                (ca, ra, na, sa, ba, xa, wa), (cb, rb, nb, sb, bb, xb, wb) = (opened(batch.column(c)[i].values) for c in ("of_x", "of_y"))
                at, bt = np.nonzero((ra[:, None] != rb[None, :]) & (den * np.minimum(na[:, None], nb[None, :]) >= num * np.maximum(na[:, None], nb[None, :])))
                found = []
                for j in range(0, len(at), 32768):
                    p, q = at[j : j + 32768], bt[j : j + 32768]
                    left = survive(sa[p], sb[q], fewest)
                    p, q = p[left], q[left]
                    for u, v in {*zip(wa[p].tolist(), wb[q].tolist(), strict=True)}:
                        of = np.flatnonzero((wa[p] == u) & (wb[q] == v))
                        for o in range(0, len(of), max(1, (1 << 20) // max(u, v))):
                            pp, qq = p[of[o : o + max(1, (1 << 20) // max(u, v))]], q[of[o : o + max(1, (1 << 20) // max(u, v))]]
                            ok = most_alike((np.stack([xa[z] for z in pp]), na[pp]), (np.stack([xb[z] for z in qq]), nb[qq]), num, den)
                            pp, qq = pp[ok], qq[ok]
                            if len(pp):
                                first = ba[pp, (ba[pp] == bb[qq]).argmax(axis=1)] == key
                                found.append((ca[pp[first]], cb[qq[first]]))
                a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["a", "b"])

    known = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = written(met_.mapInArrow(trimmed(meet), "a long, b long").distinct().join(known, ["a", "b"], "left_anti"), "more")
    drop_written(blocks, placed, names, per_root)
    return more


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows are linked if their sets of distinct k-word shingles have den * intersection >= num * union;
    component_id is the least doc_id reachable by links, kept says whether it is the row's own. A row
    without words is linked with nothing. Rows that share a doc_id are told apart by their texts; null
    ids count as greater than all others. Other columns are not read; an empty table gives an empty one.

    At similarity 0.8 a pair misses all bands with probability 5e-6, and is pruned by its signatures
    with posterior probability under miss.
    """
    signed = written(_signed(docs, k, doc_id, text), "signed")
    fewest = fewest_matches(num / den, miss)
    # Equal sets: partial sums first, so a set that a third of all rows have is a row for each task.
    heads = signed.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(heads.withColumn("cid", F.monotonically_increasing_id()), "classes")
    many = classes.count()
    bands = classes.select("cid", F.explode("bands").alias("key"))
    shared = written(bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    by_key = shared.select("key", F.col("m").alias("_n"))
    members = written(joined(bands, shared, ["key"], by_key, many * BANDS), "members")
    weight = members.groupBy("cid").agg(F.sum(F.col("m") - 1).alias("w"))
    weighed = members.join(weight, "cid")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("cid")).alias("k"))).alias("p")).select("key", (-F.col("p.k")).alias("b"))
    sigs = classes.select("cid", "sig")
    stars = written(joined(members, pivots, ["key"], by_key, many * BANDS).filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct(), "stars")
    with_b = joined(stars, sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), ["b"])
    tried = written(_pruned(with_b.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a"), fewest), "tried")
    sets = _sets(docs, classes, tried.select(F.explode(F.array("a", "b")).alias("cid")), k, doc_id, text)
    links = _exact(tried, sets, num, den)
    drop_written(sets, stars)
    labels = connected_components(links)
    # Buckets of several components: the rest of their pairs, between components only.
    placed = written(members.select("key", "cid").join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root")), "rooted")
    split = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").filter("m > 2")
    open_ = written(joined(placed, split.select("key"), ["key"], by_key, many * BANDS), "open")
    if not open_.isEmpty():
        sets = _sets(docs, classes, open_, k, doc_id, text)
        more = _between(open_, classes.select("cid", "n", "sig", "bands").join(sets.select("cid", "bits"), "cid"), tried, fewest, num, den)
        labels = connected_components(links.unionByName(_exact(more, sets, num, den)))
        drop_written(sets, more)
    drop_written(members, placed, open_, shared, tried)
    rooted = written(classes.select("h1", "h2", "n", "docs", "rep", "cid").join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "roots")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = joined(rooted, named, ["root"], total=many).select("h1", "h2", "n", "component")
    rows = signed.select("doc_id", "n", "h1", "h2")
    linked = joined(rows.filter("n > 0"), of_class, ["h1", "h2", "n"], rooted.select("h1", "h2", "n", F.col("docs").alias("_n")))
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
