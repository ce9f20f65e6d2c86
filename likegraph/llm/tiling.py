"""Benchmark decontamination by greedy string tiling.

A document meets an item of the benchmark where they share a run of ``least`` words, which a running
Karp-Rabin hash finds. Of each pair that meets, the longest common run of words that no tile covers is
made a tile, again and again, so passages are found in whatever order they come. The share of an item's
words under tiles is its coverage.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likegraph.llm.shared import beside, text_slices, written
from likegraph.llm.shingles import powers, word_hashes
from likegraph.workers import trimmed

#: Karp-Rabin multiplier, modulo 2 ** 64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def running_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of length words, by the recurrence of prefix hashes (all runs at once); none if there are fewer words."""
    runs = max(0, len(words) - length + 1)
    out = np.zeros(runs, dtype=np.uint64)
    for j in range(length if runs else 0):
        out = out * _BASE + words[j : j + runs]
    return out


class Words:
    """Hashed words of one text, with prefix sums that give the hash of any run."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.up, down = powers(len(words))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * down[: len(words)], dtype=np.uint64)])

    def runs(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.up[at]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] places each, in a row."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def longest_matches(doc: Words, item: Words, at: np.ndarray, key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in doc, place in item, words) of each common run of least words or more that can't be made longer on either side.

    at and key are places in doc and the hashes of their runs of least words. Where a word is repeated, only
    pairs that no equal pair of words precedes are made, so there are no more of them than such runs.
    """
    own = running_hashes(item.words, least)
    kinds, kind = np.unique(own, return_inverse=True)
    near = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1) if len(kinds) else np.zeros(len(key), int)
    hit = np.flatnonzero(kinds[near] == key) if len(kinds) else np.zeros(0, int)
    at, near = at[hit], near[hit]
    # the word before each place, as a number; texts begin with words that equal none
    names = np.unique(item.words)
    width = len(names) + 2
    before = np.concatenate([[width - 2], np.searchsorted(names, item.words)])[: len(own)]
    code = kind * width + before
    order = np.argsort(code, kind="stable")
    code = code[order]
    last = doc.words[np.maximum(at - 1, 0)]
    place = np.minimum(np.searchsorted(names, last), len(names) - 1) if len(names) else np.zeros(len(at), int)
    met = (at > 0) & (names[place] == last) if len(names) else np.zeros(len(at), bool)
    mine = near * width + np.where(met, place, width - 1)
    lo, hi = np.searchsorted(code, near * width), np.searchsorted(code, (near + 1) * width)
    same, past = np.searchsorted(code, mine), np.searchsorted(code, mine, side="right")
    i = np.concatenate([np.repeat(at, same - lo), np.repeat(at, hi - past)])
    j = order[np.concatenate([_ranges(lo, same - lo), _ranges(past, hi - past)])]
    short, long = np.full(len(i), least), np.minimum(len(doc.words) - i, len(item.words) - j)
    while (open_ := np.flatnonzero(short < long)).size:
        middle = (short[open_] + long[open_] + 1) // 2
        equal = doc.runs(i[open_], middle) == item.runs(j[open_], middle)
        short[open_] = np.where(equal, middle, short[open_])
        long[open_] = np.where(equal, long[open_], middle - 1)
    return i, j, short


def tiles(doc: np.ndarray, item: np.ndarray, matches: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first; ties: first in the item, then in the document.

    A match that meets a tile made before is cut to what is left of it. Words are compared once more before
    they are covered. It ends when the item has no room left for a run of least words.
    """
    heap = [(-int(n), int(j), int(i)) for i, j, n in zip(*matches, strict=True)]
    heapify(heap)
    in_doc, in_item, out = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool), []
    while heap:
        n, j, i = heappop(heap)
        taken = in_doc[i : i - n] | in_item[j : j - n]
        if not taken.any():
            taken = doc[i : i - n] != item[j : j - n]
        if not taken.any():
            in_doc[i : i - n] = in_item[j : j - n] = True
            out.append((i, j, -n))
            free = np.flatnonzero(np.diff(np.concatenate([[True], in_item, [True]])))
            if not len(free) or (free[1::2] - free[0::2]).max() < least:
                break
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heappush(heap, (a - b, j + a, i + a))
    return out


class Block:
    """Items of a benchmark and their runs of least words."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.items, self.least = ids, [], least
        keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for start, _, some in text_slices(pa.array(texts, pa.large_string()), 1_000_000):
            words, owner = word_hashes(some)
            cuts = np.searchsorted(owner, np.arange(len(some) + 1))
            for k in range(len(some)):
                own = words[cuts[k] : cuts[k + 1]].copy()
                self.items.append(own)
                runs = np.unique(running_hashes(own, least))
                keys.append(runs)
                of.append(np.full(len(runs), start + k))
        key, of = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(key, kind="stable")
        self.key, self.of = key[order], of[order]

    def coverages(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text, (item, coverage) of each item that it meets."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        words, owner = word_hashes(texts)
        runs = running_hashes(words, self.least)
        if not len(self.key) or not len(runs):
            return out
        near = np.minimum(np.searchsorted(self.key, runs), len(self.key) - 1)
        hit = np.flatnonzero((self.key[near] == runs) & (owner[: len(runs)] == owner[self.least - 1 :]))
        starts, owned = np.searchsorted(owner, np.arange(len(texts) + 1)), owner[hit]
        for d in np.unique(owned).tolist():
            own = hit[np.searchsorted(owned, d) : np.searchsorted(owned, d, side="right")]
            found = np.unique(runs[own])
            lo, hi = np.searchsorted(self.key, found), np.searchsorted(self.key, found, side="right")
            doc, at, key = Words(words[starts[d] : starts[d + 1]]), own - starts[d], runs[own]
            for k in np.unique(self.of[_ranges(lo, hi - lo)]).tolist():
                item = self.items[k]
                made = tiles(doc.words, item, longest_matches(doc, Words(item), at, key, self.least), self.least)
                out[d].append((k, sum(t[2] for t in made) / len(item)))
        return out

    def found(self, texts: list[str], threshold: float) -> tuple[list, list[float], list[list], list[bool]]:
        """For each text: best_item, coverage, items and contaminated, as ``contamination`` has them."""
        out = ([], [], [], [])
        for met in self.coverages(texts):
            most = max((c for _, c in met), default=0.0)
            named = [self.ids[j] for j, c in met if c == most and self.ids[j] is not None]
            over = {self.ids[j] for j, c in met if c >= threshold}
            for column, value in zip(out, (min(named, default=None), most, sorted(x for x in over if x is not None), bool(over)), strict=True):
                column.append(value)
        return out


#: The last block that this process has built: tasks of one pass share it.
_BUILT: dict[str, Block] = {}


def _built(name: str, items, least: int) -> Block:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Block(*items, least)
    return _BUILT[name]


def too_short(benchmark: DataFrame, least: int = 5, item_text: str = "text") -> DataFrame:
    """The rows of benchmark that no document can meet: null texts and those of fewer than least words."""
    return benchmark.filter(F.size(F.filter(F.split(F.coalesce(item_text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) < least)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 5, threshold: float = 0.8, block_chars: int = 20_000_000) -> DataFrame:
    """docs' columns named in keep, with best_item, coverage, items and contaminated.

    items are the ids of those with at least threshold of their words under tiles, ascending, each once;
    best_item has the greatest coverage (ties: the least id; null if none is met). A document is contaminated
    by any item of that coverage, also by one without an id, which items can't name. Rows of the benchmark
    that are equal in id and text count once. Null texts and texts or items of fewer than least words meet
    nothing; ``too_short`` gives those items. Repeated documents each have their row. A kept column whose
    name clashes with an added one gets underscores in front. Empty tables: no rows, or no row contaminated.

    The benchmark is taken in blocks of about block_chars characters, so its size is not bounded by memory.
    One block is one pass over docs, which move nowhere. For more, docs are written once with a number for
    each row, and each block is a pass of its own that writes what it met.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    kind = items.schema["item_id"].dataType
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    added = [("best_item", kind), ("coverage", T.DoubleType()), ("items", T.ArrayType(kind)), ("contaminated", T.BooleanType())]
    kept = docs.select(*keep)
    names = beside(kept.columns, [n for n, _ in added])
    inner = [f"c{k}" for k in range(len(names))]
    rows = docs.select(*keep, F.col(text).alias("__text")).toDF(*inner, "text")

    def met_by(rows: DataFrame, k: int, all_rows: bool) -> DataFrame:
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        id_type, name = own.schema.field("item_id").type, uuid4().hex
        shared = spark.sparkContext.broadcast((own["item_id"].to_pylist(), own["text"].to_pylist()))
        kinds = (id_type, pa.float64(), pa.list_(id_type), pa.bool_())
        plain = [c for c in rows.columns if c != "text"]

        def run(batches):
            block = _built(name, shared.value, least)
            for batch in batches:
                for a, b, texts in text_slices(batch.column(batch.num_columns - 1), 1_000_000):
                    got = [pa.array(x, t) for x, t in zip(block.found(texts, threshold), kinds, strict=True)]
                    out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(len(plain))), *got], [*plain, *(n for n, _ in added)])
                    yield out if all_rows else out.filter(pa.array([c > 0 for c in got[1].to_pylist()]))

        schema = rows.select(*plain).schema
        for n, t in added:
            schema = schema.add(n, t)
        return rows.select(*plain, "text").mapInArrow(trimmed(run), schema)

    if blocks == 1:
        out = met_by(rows, 0, True)
    else:
        rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")
        met = None
        for k in range(blocks):
            part = written(met_by(rows.select("rid", "text"), k, False), "met")
            met = part if met is None else met.unionByName(part)
        # greatest coverage, then the least id, with null ids last
        first = F.struct((-F.col("coverage")).alias("less"), F.col("best_item").isNull().alias("none"), "best_item")
        met = met.groupBy("rid").agg(F.min(first).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("contaminated").alias("contaminated"))
        met = met.select("rid", F.col("best.best_item").alias("best_item"), (-F.col("best.less")).alias("coverage"), "items", "contaminated")
        whole = rows.drop("text").join(met, "rid", "left")
        empty = F.array().cast(T.ArrayType(kind))
        out = whole.select(*inner, "best_item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", empty).alias("items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))
    return out.toDF(*names, *(n for n, _ in added))
