"""Quartile bucket digests of documents, and how alike two digests are.

A digest has a byte for the length (on a log scale), two nibbles for how the quartiles of the bucket counts
stand to each other, and two bits for each of ``BUCKETS`` buckets: the quartile its count falls in. Counts
are of hashed byte triplets within a window of five bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likegraph.llm.shared import text_slices, written
from likegraph.workers import trimmed

BUCKETS = 256
#: Places of the second and third byte of each triplet after its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: A difference of so much, or more, is likeness 0.
BOUND = 400
#: A step of the length code is a factor of e ** (1 / LENGTH_STEPS).
LENGTH_STEPS = 12
#: Bytes counted at a time: bounds the memory that a long text takes.
_STEP = 500_000


def _mix(seed: int) -> np.ndarray:
    """A byte for each byte, by a multiplicative rule."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.uint8)


_ROLES = tuple(_mix(s) for s in (1, 257, 513))
_SALTS = tuple(int(s) for s in _mix(769)[: len(TRIPLETS)])


def digests(texts: list[bytes]) -> np.ndarray:
    """A row of codes (length, two ratios, a quartile for each bucket) for each text."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    counts = np.zeros(n * BUCKETS, dtype=np.int64)
    for p in range(0, len(flat), _STEP):  # a step's first bytes, and up to four after them
        e = min(p + _STEP, len(flat))
        here = np.clip(ends, p, e) - np.clip(ends - sizes, p, e)
        owner, left = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, here), np.repeat(ends, here) - np.arange(p, e)
        first, second, third = (t[flat[p : e + 4]] for t in _ROLES)
        for (j, k), salt in zip(TRIPLETS, _SALTS, strict=True):
            at = np.flatnonzero(left > k)
            bucket = first[at] ^ second[at + j] ^ third[at + k] ^ np.uint8(salt)
            counts += np.bincount(owner[at] + bucket, minlength=len(counts))
    counts = counts.reshape(n, BUCKETS)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.zeros((n, 3 + BUCKETS), dtype=np.uint8)
    out[:, 0] = np.minimum(255, np.rint(LENGTH_STEPS * np.log1p(sizes)))
    out[:, 1:3] = q[:, :2] * 15 // np.maximum(q[:, 2:], 1)
    out[:, 3:] = (counts[:, :, None] > q[:, None, :]).sum(axis=2)
    return out


def to_hex(codes: np.ndarray) -> list[str]:
    bits = codes[:, 3:].reshape(len(codes), -1, 4)
    packed = bits[:, :, 0] << 6 | bits[:, :, 1] << 4 | bits[:, :, 2] << 2 | bits[:, :, 3]
    rows = np.concatenate([codes[:, :1], codes[:, 1:2] << 4 | codes[:, 2:3], packed], axis=1)
    return [r.tobytes().hex() for r in rows]


def from_hex(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), dtype=np.uint8)
    codes = (raw[2:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
    return np.concatenate([raw[:1], [raw[1] >> 4, raw[1] & 15], codes.ravel()]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling with the difference to 0 at BOUND.

    A bucket differs by 0, 1 or 2, and by 6 from the lowest quartile to the highest; lengths by up to 24
    steps; ratios, on their circle of 16, by up to 8.
    """
    a, b = a.astype(np.int16), b.astype(np.int16)
    gap = np.abs(a - b)
    quartiles = gap[:, 3:]
    ratio = np.minimum(gap[:, 1:3], 16 - gap[:, 1:3])
    total = quartiles.sum(axis=1) + 3 * (quartiles == 3).sum(axis=1) + np.minimum(gap[:, 0], 24) + ratio.sum(axis=1)
    return 1 - np.minimum(total, BOUND) / BOUND


def edited_text(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(texts: list[str], after: list[str]) -> list[pa.Array]:
    """The columns of _ROW for texts, each with the text after it."""
    edited = [edited_text(t, a).encode("utf-8", "surrogatepass") for t, a in zip(texts, after, strict=True)]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    last = digests([after[-1].encode("utf-8", "surrogatepass")])
    own, cut = digests(raw), digests(edited)
    nxt = np.concatenate([own[1:], last]) if all(x is y for x, y in zip(texts[1:], after, strict=False)) else digests([a.encode("utf-8", "surrogatepass") for a in after])
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(to_hex(own)), pa.array(to_hex(cut)), pa.array(likeness(own, cut)), pa.array(likeness(own, nxt))]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest, that of its edited text (see edited_text, with the next document), and how alike they are.

    The next document is by ascending doc_id, after the last the first; null ids come first, equal ids
    follow each other by text, and one document alone is its own next. Null text counts as empty. Other
    columns are not read. Returns doc_id and the columns of _ROW.

    One shuffle deals documents by ranges of doc_id; a partition's last document waits for the first of
    the next partition that has any, so only a text or two of each partition move again.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [c.split()[0] for c in _ROW.split(", ")]

    def batch_of(ids, cols, role, part, texts=None):
        n = len(ids)
        cols = cols or [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([ids, *cols, pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())], ["doc_id", *names, "part", "role", "text"])

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids = batch.column(0)
            for a, b, these in text_slices(batch.column(1), 1_000_000):
                own = ids.slice(a, b - a)
                if held is None:
                    yield batch_of(own.slice(0, 1), None, 2, part, these[:1])
                else:
                    these, own = [held[1], *these], pa.concat_arrays([held[0], own])
                if len(these) > 1:
                    yield batch_of(own.slice(0, len(own) - 1), _rows(these[:-1], these[1:]), 0, part)
                held = own.slice(len(own) - 1), these[-1]
        if held is not None:
            yield batch_of(held[0], None, 1, part, [held[1]])

    schema = f"doc_id {kind}, {_ROW}, part int, role int, text string"
    ordered = docs.select(F.col(doc_id), F.col(text)).repartitionByRange(doc_id).sortWithinPartitions(doc_id, text)
    out = written(ordered.mapInArrow(trimmed(run), schema), "digests")

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_rows([batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()])], ["doc_id", *names])

    heads, tails = (out.filter(F.col("role") == r) for r in (2, 1))
    # one row for each partition that has documents
    turn = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    waiting = tails.select("doc_id", "text", "part").join(turn, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("next")), "after").select("doc_id", "text", "next")
    return out.filter(F.col("role") == 0).select("doc_id", *names).unionByName(waiting.mapInArrow(trimmed(finish), f"doc_id {kind}, {_ROW}"))
