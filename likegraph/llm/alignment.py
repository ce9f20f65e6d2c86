"""Alignment of the tokens of two vocabularies over the same bytes.

Both vocabularies' tokens are intervals of a text's bytes; a group ends where a token of each ends, and a
link is a pair of tokens, one of each, that end together. A process keeps intervals in DuckDB tables: running
sums give the ends, equal ends the links, ASOF joins the group of each token.

Neither vocabulary has a token that goes on past a single space between other characters, so a text is cut
there, each chunk keeps the space before it, and only chunks not met before are aligned. White space of
several characters stays inside a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likegraph.llm.shared import drop_written, text_slices, written
from likegraph.llm.tokens import _BYTES
from likegraph.spread import joined
from likegraph.workers import let_workers_import, trimmed

#: Chunks that a worker keeps, and distinct pairs whose counts are broadcast (17 bytes each); more pairs are joined.
MOST_CHUNKS, MOST_PAIRS = 400_000, 4_000_000
#: Bytes of chunks that are aligned at once (or one chunk).
RUN = 1_000_000
_LONG = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")

_TOKENS = """create or replace temp table {t} as
select row_number() over () as pos, id, n, sum(n) over (rows unbounded preceding)::bigint as e from {t}_ids"""
_CUTS = "create or replace temp table cut as select distinct e as g from a semi join b using (e)"
#: Each token in its group: the first place not before its end where both have an end.
_GROUPED = "create or replace temp table {t}_in as select cut.g, {t}.pos, {t}.id, {t}.n, {t}.e from {t} asof join cut on {t}.e <= cut.g"
#: The tokens of both sides by group and side; numbered groups are those of the running sum of ends.
_MERGED = """
with sides as (select g, 0 as side, pos, id from a_in union all select g, 1, pos, id from b_in)
select id, side, g, k from sides asof join chunk on sides.g <= chunk.e order by g, side, pos"""
_LINKS = """
with met as (select a.id * {width}::bigint + b.id as code, e, a.pos as p, b.pos as q from a join b using (e))
select k, code from met asof join chunk on met.e <= chunk.e order by met.e, p, q"""
_GROUPS = """
with x as (select g, list(id order by pos) as ids, sum(n) as bytes from a_in group by g), y as (select g, list(id order by pos) as ids from b_in group by g)
select k, row_number() over (partition by k order by g) - 1 as number, g - bytes - before as start, g - before as stop, x.ids as a, y.ids as b
from x join y using (g) asof join chunk on x.g <= chunk.e order by g"""
_OVERLAPS = """
with x as (select *, e - n as s, pos - 1 as i from a_in), y as (select *, e - n as s, pos - 1 as i from b_in)
select k, x.i - first_a as a, y.i - first_b as b, least(x.e, y.e) - greatest(x.s, y.s) as bytes
from x join y on x.g = y.g and x.s < y.e and y.s < x.e asof join chunk on x.e <= chunk.e order by x.pos, y.pos"""


def a_bytes(path: str) -> list[bytes]:
    """Each id's bytes, of a byte-level vocabulary of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {chr(c): b for b, c in _BYTES.items()}
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for said, k in vocab.items():
        out[k] = bytes(back[c] for c in said) if all(c in back for c in said) else said.encode()
    return out


def b_bytes(pieces: list[str]) -> list[bytes]:
    """Each id's bytes, of a sentencepiece vocabulary."""
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


class Aligner:
    """What a worker knows of the two vocabularies, and of the chunks it has aligned."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a)
        self.tokenizer.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes = {"a": a_bytes(a), "b": b_bytes(names)}
        self.size = {t: np.array([len(x) for x in v]) for t, v in self.bytes.items()}
        self.digits = np.array([str(i) for i in range(max(map(len, self.bytes.values())))], dtype=object)
        with open(a, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        #: Chunks stand alone: no piece has a space behind another character, and the other vocabulary keeps a space with what follows.
        self.apart = not any("▁" in p.lstrip("▁") for p in names) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.con = duckdb.connect(config={"threads": 1})
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.count = np.zeros((0, 3), dtype=np.int64)  # tokens of a, of b, groups; -1: the bytes differ
        self.said: list[str] = []
        self.starts, self.codes = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def width(self) -> int:
        return len(self.bytes["b"])

    def chunks(self, text: str) -> list[str]:
        """What ``text`` after a space is made of, each without the space before it."""
        if not self.apart:
            return [text]
        return _CUT.split(text) if _LONG.search(text) or text[0].isspace() or text[-1].isspace() else text.split(" ")

    def _ids_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all chunks, each after a space, and how many each has. Chunks without white space at their ends are encoded as one text and cut at their bytes."""
        alone = np.array([not self.apart or c[0].isspace() or c[-1].isspace() for c in chunks], dtype=bool)
        rest = np.flatnonzero(~alone)
        flat, sizes = [], np.zeros(len(chunks), dtype=np.int64)
        for k in range(0, len(rest), 2048):
            part = [" " + chunks[i] for i in rest[k : k + 2048]]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            cuts = np.searchsorted(np.cumsum(self.size["a"][ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            sizes[rest[k : k + 2048]] = np.diff(cuts, prepend=0)
            flat.append(ids)
        by_itself = self.tokenizer.encode_batch_fast([" " + chunks[i] for i in np.flatnonzero(alone)], add_special_tokens=False)
        sizes[alone] = [len(e.ids) for e in by_itself]
        flat = np.concatenate([*flat, *(np.asarray(e.ids, dtype=np.int64) for e in by_itself), np.zeros(0, np.int64)])
        if not by_itself:
            return flat, sizes
        order = np.concatenate([rest, np.flatnonzero(alone)])
        start = np.empty(len(chunks), dtype=np.int64)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[_ranges(start, sizes)], sizes

    def _ids_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.pieces.encode(chunks, num_threads=1)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum())), sizes

    def _tables(self, chunks: list[str]) -> np.ndarray:
        """Fills the tables of both sides with the chunks whose bytes agree, a byte space before each; which these are."""
        ids = {"a": self._ids_a(chunks), "b": self._ids_b(chunks)}
        told = [(" " + c).encode() for c in chunks]
        length, whole = np.fromiter(map(len, told), dtype=np.int64, count=len(told)), b"".join(told)
        good = np.ones(len(chunks), dtype=bool)
        for t, (flat, sizes) in ids.items():
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(self.size[t][flat])])
            if b"".join(map(self.bytes[t].__getitem__, flat.tolist())) != whole or (sums[ends] - sums[ends - sizes] != length).any():
                good &= [b"".join(map(self.bytes[t].__getitem__, flat[e - n : e].tolist())) == x for e, n, x in zip(ends.tolist(), sizes.tolist(), told, strict=True)]
        use = np.flatnonzero(good)
        ends = np.cumsum(length[use])
        before = {t: np.cumsum(sizes[use]) - sizes[use] for t, (_, sizes) in ids.items()}
        self.con.register("chunk", pa.table({"k": use, "e": ends, "before": ends - length[use], "first_a": before["a"], "first_b": before["b"]}))
        for t, (flat, sizes) in ids.items():
            flat = flat if good.all() else flat[_ranges((np.cumsum(sizes) - sizes)[use], sizes[use])]
            self.con.register(f"{t}_ids", pa.table({"id": flat, "n": self.size[t][flat]}))
            self.con.execute(_TOKENS.format(t=t))
            self.con.unregister(f"{t}_ids")
        self.con.execute(_CUTS)
        for t in "ab":
            self.con.execute(_GROUPED.format(t=t))
        return good

    def _learn(self, chunks: list[str]) -> None:
        good = self._tables(chunks)
        count, said = np.zeros((len(chunks), 3), dtype=np.int64), [""] * len(chunks)
        count[~good] = -1
        ids, side, g, k = (c.to_numpy() for c in self.con.sql(_MERGED).to_arrow_table().columns)
        if len(ids):
            same = lambda x: np.append(False, x[1:] == x[:-1])
            new, turned = ~same(g), ~same(side)
            for j, x in enumerate((side == 0, side == 1, new)):
                count[:, j] += np.bincount(k[x], minlength=len(chunks))
            marks = np.where(new, ";", np.where(turned, "|", ",")).astype(object)
            first = np.flatnonzero(~same(k))
            marks[first] = ""
            parts, ends = (marks + self.digits[ids]).tolist(), [*first[1:].tolist(), len(ids)]
            for i, start, stop in zip(k[first].tolist(), first.tolist(), ends, strict=True):
                said[i] = "".join(parts[start:stop])
        links = self.con.sql(_LINKS.format(width=self.width)).to_arrow_table()
        self.count = np.concatenate([self.count, count])
        self.said += said
        self.codes = np.concatenate([self.codes, links["code"].to_numpy()])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(links["k"].to_numpy(), minlength=len(chunks)))])

    def _shrink(self, n: int) -> None:
        """Keeps the n chunks that came first: frequent ones come early."""
        self.index = {c: i for c, i in self.index.items() if i < n}
        self.count, self.said, self.starts = self.count[:n].copy(), self.said[:n], self.starts[: n + 1].copy()
        self.codes = self.codes[: self.starts[-1]].copy()

    def align(self, texts: list[str]):
        """For each text: tokens of a, of b, groups; its groups as text; its links as codes (a * width + b). Nothing where it is empty or bytes differ."""
        split = [self.chunks(t) if t else [] for t in texts]
        if len(self.index) > MOST_CHUNKS:
            self._shrink(MOST_CHUNKS // 2)
        new = [c for c in dict.fromkeys(chain.from_iterable(split)) if c not in self.index]
        for c in new:
            self.index[c] = len(self.index)
        for run in _runs(new):
            self._learn(run)
        for chunks in split:
            at = np.fromiter(map(self.index.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            count = self.count[at]
            if not len(at) or (count[:, 0] < 0).any():
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            codes = self.codes[_ranges(self.starts[at], self.starts[at + 1] - self.starts[at])]
            yield *count.sum(axis=0).tolist(), ";".join(map(self.said.__getitem__, at.tolist())), codes

    def whole(self, texts: list[str], sql: str) -> pa.Table:
        """What sql says of the tables of whole texts; k is the text's number."""
        self._tables(texts)
        return self.con.sql(sql).to_arrow_table()


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def _runs(chunks: list[str]):
    """chunks in runs of about RUN bytes."""
    ends = np.cumsum([len(c) for c in chunks])
    start = 0
    while start < len(chunks):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + RUN, side="right")))
        yield chunks[start:stop]
        start = stop


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each process and pair of vocabularies."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def token_groups(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, number, start, stop, a, b) for each group of each text: its bytes in space+text, the ids of both vocabularies. Odd rows: see ``align``."""
    return _whole(docs, a, b, doc_id, text, _GROUPS, "number long, start long, stop long, a array<long>, b array<long>")


def token_overlaps(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, bytes) for each two tokens, by their places, that have bytes in common. Odd rows: see ``align``."""
    return _whole(docs, a, b, doc_id, text, _OVERLAPS, "a long, b long, bytes long")


def _whole(docs: DataFrame, a: str, b: str, doc_id: str, text: str, sql: str, schema: str) -> DataFrame:
    let_workers_import(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        own = aligner(a, b)
        for batch in batches:
            for start, _, texts in text_slices(batch.column(1), 1_000_000):
                use = [i for i, t in enumerate(texts) if t]
                if use:
                    got = own.whole([texts[i] for i in use], sql)
                    at = pa.array(start + np.array(use)[got["k"].to_numpy()], pa.int64())
                    for part in pa.table([batch.column(0).take(at), *(got[n].cast(t) for n, t in zip(names, types, strict=True))], ["doc_id", *names]).to_batches(100_000):
                        yield part

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def _counted(batches):
    """Partial counts of a task's links: code, n."""
    held, many = [], 0

    def told():
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    for batch in batches:
        codes = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(0) if x.is_valid), np.uint64 if batch.schema.names[0] == "wide" else np.uint32)
        held.append(codes)
        many += len(codes)
        if many > 2_000_000:
            yield told()
            held, many = [], 0
    if many:
        yield told()


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    a: a byte-level file of the tokenizers library, which reads a space and the text; b: a sentencepiece
    model, which adds that space itself. Special tokens' strings in texts are plain text. A pair of ids counts
    as often as it is linked in all texts; n_best are the links whose count is the highest of their b id.
    Null and empty texts, and texts that either vocabulary can't give back byte by byte, have no tokens:
    zeros and ''. Rows that share an id, or have none, are rows of their own; other columns are not read; an
    empty table gives an empty one. A text of any length is read whole.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    narrow = len(a_bytes(a)) * _pieces(b) < 1 << 32
    links = "narrow" if narrow else "wide"

    def run(batches):
        own = aligner(a, b)
        for batch in batches:
            for start, stop, texts in text_slices(batch.column(1), 1_000_000):
                rows = list(own.align(texts))
                said = [hashlib.sha256(r[3].encode()).hexdigest() if r[0] else "" for r in rows]
                codes = [r[4].astype(np.uint32 if narrow else np.uint64).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(3)), pa.array([len(r[4]) for r in rows], pa.int64()), pa.array(said, pa.string()), pa.array(codes, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", links])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    aligned = written(rows.mapInArrow(trimmed(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {links} binary"), "aligned")
    parts = aligned.select(links).mapInArrow(trimmed(_counted), "code long, n long")
    pairs = written(parts.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.pmod("code", F.lit(_pieces(b)))
    best = joined(pairs.withColumn("b", of_b), pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("most")), ["b"]).select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    best = written(best, "best")
    drop_written(pairs)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if best.count() > most_pairs:
        placed = written(aligned.withColumn("_row", F.monotonically_increasing_id()), "placed")
        drop_written(aligned)

        def apart(batches):
            for batch in batches:
                for row, x in zip(batch.column(0), batch.column(1), strict=True):
                    code, n = np.unique(np.frombuffer(x.as_buffer(), np.uint32 if narrow else np.uint64), return_counts=True)
                    if len(code):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row.as_py())), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["_row", "code", "k"])

        each = written(placed.select("_row", links).mapInArrow(trimmed(apart), "_row long, code long, k long"), "each")
        sums = joined(each, best, ["code"]).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        return placed.join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"]).select(*out)
    table = best.orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast([table[c].to_numpy() for c in ("code", "n", "best")])

    def look(batches):
        code, n, top = shared.value
        for batch in batches:
            sums = [(0, 0)] * batch.num_rows
            for i, x in enumerate(batch.column(6)):
                own = np.frombuffer(x.as_buffer(), np.uint32 if narrow else np.uint64).astype(np.int64)
                if len(own):
                    at = np.searchsorted(code, own)
                    sums[i] = int(top[at].sum()), int(n[at].sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *(pa.array([s[j] for s in sums], pa.int64()) for j in (0, 1)), batch.column(5)], out)

    looked = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", links)
    return looked.mapInArrow(trimmed(look), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _pieces(b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b).get_piece_size()
