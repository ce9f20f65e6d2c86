"""Token ids as files of Simple-8b words.

A file: the magic, a block of 64-bit little-endian header words (ids, blocks, documents, words), the packed
words, then for each block of ``BLOCK`` ids the place of its first word (a block starts a word of its own,
so blocks can be read alone and all at once), then each document's id count packed likewise.

A word: a 4-bit selector above 60 bits of payload. Selectors 0 to 13 hold as many values as fit at one
width; 14 is a run of 240 zeros; 15 escapes a value of over 60 bits, which stands raw in the next word.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likegraph.llm.shared import new_path, text_slices, written
from likegraph.llm.tokens import encoder
from likegraph.workers import trimmed

MAGIC = b"S8BTOKN1"
BLOCK = 1024
# Fixed values of the published format: values in a word, and bits of each.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 240, 1])
WIDTHS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 64])
ESCAPE = 15


def simple8b(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned values, and each block's first word. All blocks are packed in step, a word of each at a time."""
    n = len(values)
    if n > block << 10:  # bounds the memory that packing takes
        parts = [simple8b(values[i : i + (block << 10)], block) for i in range(0, n, block << 10)]
        shift = np.cumsum([0, *(len(w) for w, _ in parts)])
        return np.concatenate([w for w, _ in parts]), np.concatenate([f + k for (_, f), k in zip(parts, shift, strict=False)])
    blocks = -(-n // block)
    values = np.asarray(values, dtype=np.uint64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # 65 bits, which nothing holds, stand past the end of a block
    bits = np.full((blocks, block + 256), 65, dtype=np.uint8)
    flat = np.zeros(blocks * block, dtype=np.uint64)
    flat[:n] = values
    need = _bits(flat)
    need[n:] = 65
    bits[:, :block] = need.reshape(blocks, block)
    bits = bits.ravel()
    best = np.full(len(bits), 255, dtype=np.uint8)
    spans = {1: bits}
    for sel in range(len(COUNTS) - 1):  # from few values to many: the last that fits stays
        fits = _most(spans, int(COUNTS[sel])) <= WIDTHS[sel]
        if not fits.any():  # nor will more values of fewer bits
            break
        best += fits.view(np.uint8)  # what fits so many values fits fewer, so this counts up to the last
    best[best == 255] = ESCAPE
    width, live = block + 256, np.arange(blocks)
    at, stop = live * width, live * width + np.minimum(block, n - live * block)
    wrote, order, sels, owner, where = np.zeros(blocks, dtype=np.int64), [], [], [], []
    while len(live):
        s = best[at]
        order.append(at)
        sels.append(s)
        owner.append(live)
        where.append(wrote[live])
        wrote[live] += 1 + (s == ESCAPE)
        at = at + COUNTS[s]
        more = at < stop
        at, stop, live = at[more], stop[more], live[more]
    firsts = np.cumsum(wrote) - wrote
    at, s, own = np.concatenate(order), np.concatenate(sels), np.concatenate(owner)
    place = firsts[own] + np.concatenate(where)
    words = np.zeros(int(wrote.sum()), dtype=np.uint64)
    source = own * (block - width) + at
    for sel in np.unique(s):
        k = np.flatnonzero(s == sel)
        word = np.full(len(k), np.uint64(sel) << np.uint64(60), dtype=np.uint64)
        if sel == ESCAPE:
            words[place[k] + 1] = flat[source[k]]
        elif WIDTHS[sel]:
            at_k = source[k]
            for i in range(COUNTS[sel]):
                word |= flat[at_k + i] << np.uint64(i * WIDTHS[sel])
        words[place[k]] = word
    return words, firsts


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if int(values.max(initial=0)) < 1 << 16:
        return _SHORT[values]
    if int(values.max(initial=0)) < 1 << 52:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def _most(spans: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The largest of the count values from each place on (65 where they'd pass the end)."""
    if count not in spans:
        half = max(k for k in spans if k < count)
        if 2 * half < count:
            half = count // 2
        a = _most(spans, half)
        out = np.full_like(a, 65)
        out[: len(a) - count + half] = np.maximum(a[: len(a) - count + half], a[count - half :])
        spans[count] = out
    return spans[count]


def from_simple8b(words: np.ndarray, firsts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of words. Which words hold raw values is all that needs their order."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():
        raw = np.zeros(len(words), dtype=bool)
        for k in np.flatnonzero(sel == ESCAPE):
            raw[k + 1 : k + 2] |= not raw[k]
        head = np.flatnonzero(~raw)
    else:
        head = np.arange(len(words))
    sel = sel[head]
    # a block's last word may claim more values than are left, so each block counts anew
    first = np.searchsorted(head, firsts)
    per = np.diff(np.append(first, len(head)))
    run = np.cumsum(COUNTS[sel]) - COUNTS[sel]
    start = run - np.repeat(run[first] - np.arange(len(first)) * block, per)
    out = np.zeros(n + 256, dtype=np.uint64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[k]] = words[head[k] + 1]
        elif WIDTHS[s]:
            word, to, low = words[head[k]], start[k], np.uint64((1 << int(WIDTHS[s])) - 1)
            for i in range(COUNTS[s]):
                out[to + i] = (word >> np.uint64(i * WIDTHS[s])) & low
    return out[:n]


def to_bytes(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    words, firsts = simple8b(ids)
    lengths, length_firsts = simple8b(sizes)
    head = np.array([len(ids), len(firsts), len(sizes), len(words), len(lengths), len(length_firsts)], dtype="<u8")
    return b"".join([MAGIC, head.tobytes(), words.astype("<u8").tobytes(), firsts.astype("<u8").tobytes(), lengths.astype("<u8").tobytes(), length_firsts.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and each document's count of them."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, blocks, docs, words, lengths, length_blocks = map(int, np.frombuffer(data, "<u8", 6, 8))
    at, parts = 56, []
    for k in (words, blocks, lengths, length_blocks):
        parts.append(np.frombuffer(data, "<u8", k, at))
        at += 8 * k
    return from_simple8b(parts[0], parts[1].astype(np.int64), n), from_simple8b(parts[2], parts[3].astype(np.int64), docs).astype(np.int64)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a shared folder (local paths, hdfs, s3, gs) and the path in it."""
    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", file_chars: int = 16_000_000, file_docs: int = 500_000) -> DataFrame:
    """Writes the ids of all documents, each with the end id, in ascending doc_id order.

    Partitions by range of doc_id each write files of about file_chars characters or file_docs documents,
    under names that sort as the ids do. A file is written under a name of the attempt's own and then renamed, so a task that
    runs again leaves the same files. Null text counts as empty; null ids come first; equal ids follow
    each other, by text; an empty table gives no file. A file holds token ids and each document's count of
    them; which documents they are stands in the manifest. Returns the manifest: part, file, path, doc_ids (array), n_ids.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    folder = folder or new_path(docs.sparkSession, "tokens")

    def run(batches):
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        held, number, chars = [], 0, 0

        def flush():
            nonlocal held, number, chars
            ids, sizes, names = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held]))
            name = f"{root}/part-{part:06d}-{number:06d}.s8b"
            with store.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as f:
                f.write(to_bytes(ids, sizes))
            store.move(own, name)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([len(ids)], pa.int64())], ["part", "file", "path", "doc_ids", "n_ids"])
            held, number, chars = [], number + 1, 0
            return row

        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                flat, ends = encode(texts)
                sizes = np.diff(ends, prepend=0) + 1
                ids = np.insert(flat, ends, end_id)
                held.append((ids, sizes, batch.column(0).slice(a, b - a)))
                chars += sum(map(len, texts))
                if chars >= file_chars or sum(len(h[1]) for h in held) >= file_docs:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col(doc_id), F.col(text)).repartitionByRange(doc_id).sortWithinPartitions(doc_id, text)
    return written(ordered.mapInArrow(trimmed(run), f"part int, file int, path string, doc_ids array<{kind}>, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """From the files of a manifest, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row a file, so its running sum of ids is small. An empty one gives no rows.
    """
    kind = manifest.schema["doc_ids"].dataType.elementType.simpleString()
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    base = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("base"))
    files = max(1, manifest.count())
    todo = manifest.select("part", "file", "path", "doc_ids").join(F.broadcast(base) if files <= 200_000 else base, ["part", "file"]).repartition(min(files, 20_000), "part", "file")
    scheme = folder or new_path(manifest.sparkSession, "tokens")

    def run(batches):
        store, _ = file_system(scheme)
        for batch in batches:
            for k in range(batch.num_rows):
                with store.open_input_stream(batch.column("path")[k].as_py()) as f:
                    ids, sizes = from_bytes(f.read())
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(ends - sizes + batch.column("base")[k].as_py(), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(trimmed(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
