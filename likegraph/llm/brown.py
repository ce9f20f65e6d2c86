"""Class-based n-grams: exchange clustering puts words into classes, and a text's probability is the product
of class transitions and of word emissions.

Counts cover every training token. The many rare words stay in tables: a dictionary of bounded size holds
the frequent ones, which make up most of a text, and only what it lacks is joined with the counts, where by
construction no word is hot. Classes are two bytes a word, for all words above a count.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likegraph.llm.language_id import held_out
from likegraph.llm.shared import beside, drop_written, text_slices, written
from likegraph.workers import trimmed

#: Stands for the end of a text, which no word can equal.
END = b""


def words(text: str) -> list[bytes]:
    """Runs of other than ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def vocabulary(docs: DataFrame, text: str = "text", most_held: int = 400_000) -> DataFrame:
    """The count of each token of docs (word binary, n), END included once a document. Each task sums at most most_held words at a time."""

    def run(batches):
        sums: Counter[bytes] = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return rows

        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                for t in texts:
                    sums.update(words(t))
                    if len(sums) > most_held:
                        yield out()
            sums[END] += batch.num_rows
        yield out()

    return docs.select(F.col(text)).mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """END and the words of the largest counts, most of them at the most, by descending count: down to a threshold taken from a histogram of fixed size."""
    band = F.floor(F.log2("n") * 8)
    bands = sorted(((r["b"], r["k"]) for r in counts.groupBy(band.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for b, k in bands:
        if total + k > most:
            break
        total, least = total + k, b
    rows = counts.filter((band >= least if least is not None else F.lit(False)) | (F.col("word") == F.lit(END))).toArrow()
    return dict(sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0])))


def numbered(vocabulary: DataFrame, what: str = "vocabulary") -> DataFrame:
    """vocabulary as a table with at, a number of partition and place that is stored, most frequent words first in each partition."""
    order = vocabulary.sortWithinPartitions(F.col("word") != F.lit(END), F.desc("n"))
    return written(order.withColumn("at", F.monotonically_increasing_id()), what)


def placed_tail(counts: DataFrame, dictionary: dict[bytes, int], least: int) -> tuple[DataFrame, int]:
    """counts (word, n) of numbered words with place: that of each word of at least ``least`` that dictionary lacks, from its size on without gaps, and null for all others. Also how many have one."""
    cut = min((n for w, n in dictionary.items() if w != END), default=None)
    held = (F.col("word") == F.lit(END)) | (F.lit(False) if cut is None else F.col("n") >= cut)
    takes = ~held & (F.col("n") >= least)
    part = F.shiftright("at", 33)
    sizes = sorted((r["p"], r["d"], r["k"]) for r in counts.groupBy(part.alias("p")).agg(F.count_if(held).alias("d"), F.count_if(takes).alias("k")).collect())
    starts, total = [], 0
    for p, d, k in sizes:
        starts.append((p, len(dictionary) + total - d))
        total += k
    if not total:
        return counts.select("word", "n", F.lit(None).cast("int").alias("place")), 0
    first = F.broadcast(counts.sparkSession.createDataFrame(starts, "part long, start long"))
    place = F.when(takes, F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int")
    return counts.withColumn("part", part).join(first, "part").select("word", "n", place.alias("place")), total


def planes(values: np.ndarray) -> bytes:
    """Values of no sign in as many bytes each as they need, after a byte that says how many: all lowest bytes first, then all next ones, as what moves is compressed."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def of_planes(data) -> np.ndarray:
    """The values of ``planes``."""
    raw = np.frombuffer(data, np.uint8)
    size = int(raw[0])
    out = np.zeros(((len(raw) - 1) // size, 8), np.uint8)
    out[:, :size] = raw[1:].reshape(size, -1).T
    return out.view("<i8").ravel()


def encoded(docs: DataFrame, dictionary: dict[bytes, int], keep: list[str | Column], text: str = "text", planar: bool = False) -> DataFrame:
    """docs as places of their words in dictionary (-1 for others, which tail has with where they stand): rid, keep, ids binary, tail. planar: ids are the ``planes`` of places + 1, until ``completed``."""
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionary))
    kept = docs.select(*keep)
    names = [*kept.columns, "rid", "ids", "tail"]
    store: dict[str, dict[bytes, int]] = {}

    def run(batches):
        if not store:
            store["at"] = {w: i for i, w in enumerate(shared.value)}
        at, rid = store["at"], TaskContext.get().partitionId() << 40
        tails = pa.list_(pa.struct([("word", pa.binary()), ("at", pa.binary())]))
        for batch in batches:
            for a, b, texts in text_slices(batch.column(batch.num_columns - 1), 1_000_000):
                ids, tail = [], []
                for t in texts:
                    own = words(t)
                    got = np.array([at.get(w, -1) for w in own], dtype="<i4")
                    ids.append(planes(got + 1) if planar else got.tobytes())
                    rest: dict[bytes, list[int]] = {}
                    for i in np.flatnonzero(got < 0).tolist():
                        rest.setdefault(own[i], []).append(i)
                    tail.append([{"word": w, "at": np.array(i, dtype="<i4").tobytes()} for w, i in rest.items()])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(range(rid, rid + b - a), pa.int64()), pa.array(ids, pa.binary()), pa.array(tail, tails)], names)
                rid += b - a

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "rid long, ids binary, tail array<struct<word: binary, at: binary>>"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(trimmed(run), schema)


def completed(rows: DataFrame) -> DataFrame:
    """Planar rows (ids, placed: array of place and at) with the places of placed in ids, which are no longer planar, and without placed."""
    names = [c for c in rows.columns if c not in ("ids", "placed")]

    def run(batches):
        for batch in batches:
            out = []
            for ids, placed in zip(batch.column("ids").to_pylist(), batch.column("placed").to_pylist(), strict=True):
                own = (of_planes(ids) - 1).astype("<i4")
                if placed:
                    at = [x["at"] for x in placed]
                    own[np.frombuffer(b"".join(at), dtype="<i4")] = np.repeat([x["place"] for x in placed], [len(x) // 4 for x in at])
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "ids"])

    return rows.select(*names, "placed", "ids").mapInArrow(trimmed(run), rows.select(*names, "ids").schema)


def _stream(ids: pa.Array, end: int) -> np.ndarray:
    """All documents' places in a row, an end before the first and after each."""
    sizes = np.fromiter((len(x) // 4 for x in ids.to_pylist()), dtype=np.int64, count=len(ids))
    flat = np.frombuffer(b"".join(ids.to_pylist()), dtype="<i4")
    return np.concatenate([[end], np.insert(flat, np.cumsum(sizes), end)]).astype(np.int64)


def _counted(rows: DataFrame, code, size: int) -> np.ndarray:
    """Sums over all of rows.ids of the codes (0 to size - 1) that code(stream) gives; one vector of that fixed size comes to the driver."""

    def run(batches):
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                sums += np.bincount(code(batch.column(0).slice(i, 512)), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["code", "n"])

    got = rows.select("ids").mapInArrow(trimmed(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """Classes 0..classes-1 of the words of a bigram table, whose last row and column stand for all other words and stay a class of their own.

    Each word in turn goes to the class in which the likelihood of the class bigrams is greatest, until a
    sweep moves none.
    """
    n = len(bigrams) - 1
    bigrams = bigrams.astype(float)
    of = np.append(np.arange(n) % classes, classes)
    one = np.zeros((n + 1, classes + 1))
    one[np.arange(n + 1), of] = 1
    table = one.T @ bigrams @ one
    moved = n
    while moved:  # each move raises the likelihood
        moved = 0
        for w in range(n):
            a, own = of[w], bigrams[w, w]
            right = np.bincount(of, weights=bigrams[w], minlength=classes + 1)
            left = np.bincount(of, weights=bigrams[:, w], minlength=classes + 1)
            right[a] -= own
            left[a] -= own
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            gain = (_phi(table + right) - _phi(table)).sum(axis=1) + (_phi(table + left[:, None]) - _phi(table)).sum(axis=0)
            d = table.diagonal()
            gain += _phi(d + right + left + own) + _phi(d) - _phi(d + right) - _phi(d + left)
            rows, cols = table.sum(axis=1) + left, table.sum(axis=0) + right
            gain -= _phi(rows + right.sum() + own) - _phi(rows) + _phi(cols + left.sum() + own) - _phi(cols)
            b = int(gain[:classes].argmax())
            b = b if gain[b] > gain[a] + 1e-6 else a
            of[w] = b
            moved += a != b
            table[b] += right
            table[:, b] += left
            table[b, b] += own
    return of[:n]


def classes_for(many: int) -> int:
    """How many classes many words are put into: 48 for 20,000, growing with the fourth root."""
    return max(48, round(4 * many**0.25))


def short(values: np.ndarray) -> bytes:
    """values in two, four or eight bytes each, as they fit, after a byte that says which."""
    top = int(values.max()) if len(values) else 0
    size = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _summed(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in ascending order and the sums of their n."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat, many = np.concatenate(codes), np.concatenate(n)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    return flat[first], np.add.reduceat(many[order], first) if len(first) else many


_NEIGHBOURS = ["before_sizes", "before", "before_n", "after_sizes", "after", "after_n"]


def _blocks_of(many: int) -> int:
    return min(many + 1, max(1024, -(-(many + 1) // 1024)))


def neighbours(rows: DataFrame, end: int, many: int) -> DataFrame:
    """The word bigrams of encoded rows as a table: what stands before and after each of the first many words, and, as word many, all others.

    One row a block of words (word % blocks), with, for before and after, how many different neighbours each
    word of the block has (_sizes), these in ascending order, and how often they stand there (_n): as they are
    used, so that a sweep needn't decode them. The corpus is read and shuffled once, summed in each task first;
    all that is asked of the table later needs neither.
    """
    size = many + 1
    blocks = _blocks_of(many)
    width = -(-size // blocks) * size

    def gather(batches):
        held, room = ([], []), 0

        def out():
            parts = []
            for codes in held:
                codes, n = np.unique(np.concatenate(codes), return_counts=True)
                cuts = np.searchsorted(codes, np.arange(blocks + 1) * width)
                own = np.flatnonzero(np.diff(cuts))
                codes %= width
                parts.append({k: (planes(np.diff(codes[i:j], prepend=0)), planes(n[i:j])) for k, i, j in zip(own.tolist(), cuts[own].tolist(), cuts[own + 1].tolist(), strict=True)})
            own = sorted({*parts[0], *parts[1]})
            for codes in held:
                codes.clear()
            cells = [[part.get(k, (None, None))[i] for k in own] for part in parts for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                s = _stream(batch.column(0).slice(i, 512), end)
                s = np.where((s < 0) | (s >= many), many, s)
                at = (s % blocks) * width + s // blocks * size
                held[0].append(at[1:] + s[:-1])
                held[1].append(at[:-1] + s[1:])
                room += len(s)
                if room > 2_000_000:
                    yield out()
                    room = 0
        if room:
            yield out()

    def merge(batches):
        block, sums = None, {}

        def out():
            packed = []
            for k in (1, 3):
                codes, n = _summed(sums.pop(k, []), sums.pop(k + 1, []))
                place, other = np.divmod(codes, size)
                sizes = np.bincount(place, minlength=len(range(block, size, blocks)))
                packed += [sizes.astype("<u4").tobytes(), other.astype("<u4").tobytes(), short(n)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["block", *_NEIGHBOURS])

        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != block:
                    if block is not None:
                        yield out()
                    block, sums = b, {}
                for k in (1, 3):
                    if batch.column(k)[i].is_valid:
                        sums.setdefault(k, []).append(np.cumsum(of_planes(batch.column(k)[i].as_buffer())))
                        sums.setdefault(k + 1, []).append(of_planes(batch.column(k + 1)[i].as_buffer()))
        if block is not None:
            yield out()

    names = ["block", "before", "before_n", "after", "after_n"]
    schema = "block int, before binary, before_n binary, after binary, after_n binary"
    parts = rows.select("ids").mapInArrow(trimmed(gather), schema).repartition("block").sortWithinPartitions("block")
    return written(parts.mapInArrow(trimmed(merge), "block int, " + ", ".join(f"{c} binary" for c in _NEIGHBOURS)), "neighbours")


def _told(batch: pa.RecordBatch, i: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many neighbours each word has, these, and their counts, from row i of a batch and its columns from k on."""
    sizes, other = (np.frombuffer(batch.column(j)[i].as_buffer(), "<u4") for j in (k, k + 1))
    raw = memoryview(batch.column(k + 2)[i].as_buffer())
    return sizes, other, np.frombuffer(raw[1:], f"<u{raw[0]}")


def transitions(table: DataFrame, of: np.ndarray, many: int) -> np.ndarray:
    """How often a word of each class is followed by one of each, under the classes of (many words, then all others)."""
    side, blocks = int(of.max()) + 1, _blocks_of(many)
    shared = table.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        cls, sums = shared.value, np.zeros(side * side)
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                sizes, other, n = _told(batch, i, 1)
                sums += np.bincount(np.repeat(cls[b : many + 1 : blocks].astype(np.int32) * side, sizes) + cls[other], weights=n, minlength=side * side)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["code", "n"])

    got = table.select("block", "after_sizes", "after", "after_n").mapInArrow(trimmed(run), "code int, n double").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(side, side)


def likelihood(table: np.ndarray) -> float:
    """What of the log likelihood of class bigrams depends on the classes."""
    return float(_phi(table).sum() - _phi(table.sum(axis=1)).sum() - _phi(table.sum(axis=0)).sum())


def gains(table: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By how much the likelihood rises when one word, and no other, goes from class a to another class b: exactly, for each of several words.

    before and after are the counts of classes beside each word, without the own bigrams of the word with itself.
    """
    at, rows, cols = np.arange(len(a)), table.sum(axis=1), table.sum(axis=0)
    n_row, n_col = after.sum(axis=1) + own, before.sum(axis=1) + own
    total = np.zeros(len(a))
    # most words stand beside few classes, and only what is beside them changes; the word is taken out of its class first
    for near, turned, row in ((after, before, True), (before, after, False)):
        w, c = np.nonzero(near)
        n = near[w, c]
        for x, sign in ((a, -1.0), (b, 1.0)):
            was = table[x[w], c] if row else table[c, x[w]]
            was = was - np.where(x[w] == a[w], n, 0) - np.where(c == a[w], turned[w, x[w]] + np.where(x[w] == a[w], own[w], 0), 0)
            total += sign * np.bincount(w, weights=_phi(was + n) - _phi(was), minlength=len(a))
    for x, sign in ((a, -1.0), (b, 1.0)):
        mine, r, c = x == a, after[at, x], before[at, x]
        d = table[x, x] - np.where(mine, r + c + own, 0)
        gain = _phi(d + r + c + own) + _phi(d) - _phi(d + r) - _phi(d + c)
        in_row, in_col = rows[x] - mine * n_row, cols[x] - mine * n_col
        total += sign * (gain - (_phi(in_row + n_row) - _phi(in_row) + _phi(in_col + n_col) - _phi(in_col)))
    return total


def _fits(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the classes before, and those after, a word say for each class but the last."""
    soft = seen + 0.1
    return np.log(soft / soft.sum(axis=0))[:, :-1].astype(np.float32), np.log(soft / soft.sum(axis=1, keepdims=True)).T[:, :-1].astype(np.float32)


def _best_fit(fits: tuple[np.ndarray, np.ndarray], before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (before.astype(np.float32) @ fits[0] + after.astype(np.float32) @ fits[1]).argmax(axis=1)


def _told_apart(seen: np.ndarray) -> float:
    """The least gain that is no rounding of sums of this size."""
    return max(1e-6, 1e-15 * float(_phi(seen.sum())))


def _beside(batch: pa.RecordBatch, i: int, cls: np.ndarray, side: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of the classes before and after each word of row i of a batch, and how often each stands beside itself."""
    near = []
    for k in (1, 4):
        sizes, other, n = _told(batch, i, k)
        place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        near.append(np.bincount(place * np.int32(side) + cls[other], weights=n, minlength=len(sizes) * side).reshape(-1, side))
    word = np.arange(len(sizes), dtype=np.uint32) * np.uint32(_blocks_of(len(cls) - 1)) + np.uint32(batch.column(0)[i].as_py())
    self = np.flatnonzero(other == np.repeat(word, sizes))
    return near, np.bincount(place[self], weights=n[self], minlength=len(sizes))


def proposals(table: DataFrame, of: np.ndarray, seen: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the classes that their neighbours fit best, and what each one's move there adds to the likelihood: all above nothing, but for words in the last class, where none is to stay."""
    side, blocks = len(seen), _blocks_of(many)
    shared = table.sparkSession.sparkContext.broadcast((of, seen, _fits(seen), _told_apart(seen)))

    def run(batches):
        cls, seen, fits, least = shared.value
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                words = np.arange(b, many, blocks)
                if not len(words):
                    continue
                near, own = _beside(batch, i, cls, side)
                near, own = [x[: len(words)] for x in near], own[: len(words)]
                new, now = _best_fit(fits, *near), cls[words].astype(np.int64)
                at = np.flatnonzero(new != now)
                before, after = (x[at] for x in near)
                for x in (before, after):
                    x[np.arange(len(at)), now[at]] -= own[at]
                gain = gains(seen, now[at], new[at], before, after, own[at])
                up = (gain > least) | (now[at] == side - 1)
                if up.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (words[at][up].astype("<i8"), new[at][up].astype("<i2"), gain[up].astype("<f4"))], ["word", "of", "gain"])

    got = table.mapInArrow(trimmed(run), "word binary, of binary, gain binary").toArrow()
    words, into, gain = (np.frombuffer(b"".join(got[c].to_pylist()), t) for c, t in (("word", "<i8"), ("of", "<i2"), ("gain", "<f4")))
    order = np.argsort(words)
    return words[order], into[order], gain[order]


def settled(table: DataFrame, of: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and transitions from those of of on, when no word is left whose move to the class its neighbours fit best would raise the likelihood.

    Words that are in the last class, that of all others, first go where their neighbours fit best. In each sweep all words whose own move does so are moved at once. Words that are each other's neighbours
    can spoil each other's gain: where the likelihood falls, half as many move, taken at random, down to
    the one that gains most, and fewer in the next sweep where little of the gain was kept. So it rises in
    every sweep, and the sweeps end.
    """
    seen, share, sweep = transitions(table, of, many), 1.0, 0
    if (of[:many] == len(seen) - 1).any():
        words, into, _ = proposals(table, of, seen, many)
        new = of[words] == len(seen) - 1
        of = of.copy()
        of[words[new]] = into[new]
        seen = transitions(table, of, many)
    while True:
        words, into, gain = proposals(table, of, seen, many)
        if not len(words):
            return of, seen
        order = np.random.default_rng(sweep).permutation(len(words))
        best = int(gain.argmax())
        order = np.concatenate([[best], order[order != best]])
        while True:
            take = order[: max(1, int(share * len(order)))]
            moved = of.copy()
            moved[words[take]] = into[take]
            found = transitions(table, moved, many)
            if likelihood(found) > likelihood(seen) or len(take) == 1:
                break
            share = len(take) / len(order) / 2
        if likelihood(found) <= likelihood(seen):  # a gain below what numbers of this size can tell apart
            return of, seen
        kept = (likelihood(found) - likelihood(seen)) / gain[take].sum()
        share *= 0.5 if kept < 0.3 else 1.0 if kept < 0.7 else 1.5
        of, seen, share, sweep = moved, found, min(share, 1.0), sweep + 1


def train(rows: DataFrame, dictionary: dict[bytes, int], sums: dict, classes: int | None = None, exchanged: int | None = None, assigned: int | None = None, alpha: float = 5.0, tail: int = 0, least: int = 2) -> dict:
    """The model, from encoded training rows and the counts' sums. Places below len(dictionary) are its words, tail more are other words.

    Every word of at least ``least`` (or the ``assigned`` most frequent, if given) has a class. Exchange of
    the ``exchanged`` most frequent words gives the first classes; then all words that have a class,
    themselves included, are exchanged over the table of their neighbours until none moves (``settled``).
    All further words are the class of rare ones, whose emissions are discounted for words
    not seen (as one kind of token, as in the base score).
    """
    n = np.fromiter(dictionary.values(), dtype=float, count=len(dictionary))
    end = list(dictionary).index(END) if END in dictionary else -1
    if not len(n):
        return {"of": np.zeros(0, int), "move": np.zeros((1, 1)), "say": np.zeros(0), "in_class": np.ones(1), "end": -1, "rare": 0, "rare_n": 0.0, "discount": 0.5, "rare_v": 0}
    if assigned is None:
        many = len(n) + tail if tail else int((n >= least).sum())
    else:
        many = min(assigned, len(n))
    classes = classes or classes_for(many)
    side = classes + 1
    top = min(exchanged or max(1000, 4 * classes), many, len(n))

    def pairs(ids):
        s = _stream(ids, end)
        s = np.where((s < 0) | (s >= top), top, s)
        return s[:-1] * (top + 1) + s[1:]

    bigrams = _counted(rows, pairs, (top + 1) ** 2).reshape(top + 1, top + 1)
    of = np.full(len(n) + tail + 1, classes, dtype=np.int16)  # the last, place -1: rare
    of[:top] = exchange(bigrams, classes)
    table = neighbours(rows, end, many)
    all_of, seen = settled(table, np.append(of[:many], np.int16(classes)), many)
    of[:many] = all_of[:many]
    drop_written(table)
    share = (seen.sum(axis=0) + 0.5) / (seen.sum() + 0.5 * side)
    move = np.log10((seen + alpha * share) / (seen.sum(axis=1, keepdims=True) + alpha))
    in_class = np.maximum(seen.sum(axis=0), 1)
    rare_n, rare_v = sums["n"] - seen.sum(axis=0)[:classes].sum(), sums["v"] - int((of < classes).sum())
    discount = discounted(sums)
    own = of[: len(n)]
    say = np.where(own < classes, np.log10(n / in_class[own]), np.log10(np.maximum(n - discount, 1e-9) / max(rare_n, 1)))
    return {"of": of, "move": move, "say": say, "in_class": in_class, "end": end, "rare": classes, "rare_n": float(rare_n), "discount": discount, "rare_v": rare_v}


def discounted(sums: dict) -> float:
    """What is taken from the count of each rare word."""
    return min(max(sums["n1"] / (sums["n1"] + 2 * sums["n2"]), 0.05), 0.95) if sums["n1"] else 0.5


def score(docs: DataFrame, training: Column, keep: list[str | Column], text: str = "text", dictionary_size: int = 250_000, least: int = 2, assigned: int | None = None, **options) -> DataFrame:
    """Every document under a model of those that training (a condition on kept columns' sources) holds for.

    Returns keep, n_tokens, n_known, train_tokens, base_score, score. Null text counts as empty (one end);
    repeated rows are counted and scored each; an empty table gives no rows. Without training documents
    nothing is known, and score is that of rare words alone. Words that the dictionary lacks get their places
    in the texts by a join, so its size doesn't bound the model. A kept column whose name clashes with an
    added one gets underscores in front.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    outer = beside(docs.select(*keep).columns, added)
    inner = [f"c{i}" for i in range(len(outer))]
    docs = docs.select(*keep, training.alias("__training"), F.col(text).alias("__text")).toDF(*inner, "__training", "__text")
    keep, training, text = inner, F.col("__training"), "__text"
    counts = numbered(vocabulary(docs.filter(training), text))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first().asDict()
    dictionary = frequent(counts.select("word", "n"), dictionary_size)
    placed, tail_size = placed_tail(counts, dictionary, least if assigned is None else 1 << 62)
    below, discount = sums["n"] + 0.5 * (sums["v"] + 1), discounted(sums)
    short = written(encoded(docs, dictionary, [*keep, training], text, planar=True), "encoded")
    c, k = F.col("c"), F.col("k")
    tail = short.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.word").alias("word"), F.col("t.at").alias("at"), (F.length("t.at") / 4).cast("int").alias("k"))
    if END not in dictionary:  # no training document: ends are joined like words
        tail = tail.unionByName(short.select("rid", F.lit(END).alias("word"), F.lit(None).cast("binary").alias("at"), F.lit(1).alias("k")))
    rare = c.isNotNull() & F.col("place").isNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    rest = (
        tail.join(placed.withColumnRenamed("n", "c"), "word", "left")
        .groupBy("rid")
        .agg(
            F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "at"))).alias("placed"),
            total(F.when(c.isNotNull(), k)).alias("__known"),
            F.sum(k * F.log10((F.coalesce(c, F.lit(0)) + 0.5) / below)).alias("__base"),
            total(F.when(F.col("place").isNotNull(), k * F.log10(c)).when(rare, k * F.log10(F.greatest(c - discount, F.lit(1e-9))))).alias("__said"),
            total(F.when(rare, k)).alias("__rare"),
            total(F.when(c.isNull(), k)).alias("__unseen"),
        )
    )
    sides = ("__known", "__base", "__said", "__rare", "__unseen")
    whole = short.drop("tail").join(rest, "rid", "left").drop("rid")
    whole = whole.withColumns({x: F.coalesce(x, F.lit(0)).cast("double") for x in sides})
    rows = written(completed(whole), "coded", compression="zstd")
    drop_written(short)
    model = train(rows.filter("__training"), dictionary, sums, assigned=assigned, tail=tail_size, least=least, **options)
    base = np.log10((np.fromiter(dictionary.values(), dtype=float, count=len(dictionary)) + 0.5) / below)
    rare_n = max(model["rare_n"], 1.0)
    unseen = discount * max(model["rare_v"], 1) / rare_n if model["rare_n"] else 1.0
    shared = docs.sparkSession.sparkContext.broadcast((model, base))
    names = [f.name for f in rows.schema if f.name not in ("ids", "__training", *sides)]
    kinds = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in names)

    def run(batches):
        m, log_base = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column("ids").to_pylist()
                known, of_base, of_model, n_rare, n_unseen = (part.column(x).to_numpy() for x in sides)
                sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                of_model = of_model - n_rare * np.log10(rare_n) + n_unseen * np.log10(unseen)
                if m["end"] >= 0:
                    s, size = _stream(part.column("ids"), m["end"]), len(log_base)
                    owner = np.repeat(np.arange(len(ids)), sizes + 1)
                    cls, held = m["of"][s], (s >= 0) & (s < size)
                    own = np.where(held, s, size)
                    said = np.where(s < size, np.append(m["say"], 0.0)[own], -np.log10(m["in_class"])[cls])
                    sums_of = [np.bincount(owner, weights=x, minlength=len(ids)) for x in (held[1:], np.append(log_base, 0.0)[own][1:], m["move"][cls[:-1], cls[1:]] + said[1:])]
                    known, of_base, of_model = known + sums_of[0], of_base + sums_of[1], of_model + sums_of[2]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(sizes + 1), pa.array(known.round().astype(np.int64)), pa.array(np.full(len(ids), int(sums["n"]))), pa.array(of_base), pa.array(of_model)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = rows.select(*names, *sides, "ids").mapInArrow(trimmed(run), f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.toDF(*outer, *added)


def perplexity(docs: DataFrame) -> DataFrame:
    """Learns from all but the held-out fold and scores every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null ids are in no fold and so are learned from; null text is one end; repeated rows count and are scored
    each; words of equal counts stand in order of their bytes; an empty table gives no rows.
    """
    fold = held_out(parts=5, part=1)
    return score(docs, ~fold, keep=["doc_id", fold.alias("held_out")])
