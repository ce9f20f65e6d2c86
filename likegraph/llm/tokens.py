"""Token ids of many texts by a file of the tokenizers library.

Words repeat far more often than texts, so ids are kept by chunk of text. A chunk ends where no token
of the two supported kinds of vocabulary can go on, and each new chunk is encoded by the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, islice

import numpy as np

#: White space other than the two usual characters: where white space of several kinds meets, one
#: library's idea of it may differ from another's, so such texts are encoded whole.
_ODD = [*"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff", *map(chr, range(0x2000, 0x200C))]
#: Where white space is longer than one character.
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
#: What a text of plain chunks neither starts nor ends with.
_ENDS = (" ", "\n", "")
#: A key that is a word of letters whose lower case and normal form are the same everywhere, and marks that always stand apart from it.
_WORD = re.compile("([\r\n]?)([A-Za-zÀ-ÖØ-öø-ÿĀ-įĲ-ňŊ-ž]+)([.,;:!?]*)")
#: Byte-level vocabularies show each byte as a printable character: itself, or else the next one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(k not in _PRINTABLE for k in range(b)) for b in range(256)}

_SPACE = chr(_BYTES[32])


class ChunkEncoder:
    """ids of texts, equal to those of encode(text, add_special_tokens=False).

    style "drop": the pre-tokenizer drops white space, so chunks are what stands between it.
    style "keep": white space goes with the word after it (byte-level vocabularies), so a chunk is
    white space and the word that follows. Any other file, and texts with unusual white space: encoded
    whole.

    most_chunks bounds the memory; a full store keeps the half of its chunks that came first.
    """

    def __init__(self, path: str, most_chunks: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.style, self.special = _style(spec), [t["content"] for t in spec["added_tokens"]]
        self.stop = next((t["id"] for t in spec["added_tokens"] if t["special"]), None)
        self.most_chunks = most_chunks
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.pieces: dict[str, list[int]] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)

    def rest(self, chunks: int = 150_000) -> None:
        """Gives back most of the memory; the chunks that came first are still known."""
        if len(self.index) > chunks:
            self._shrink(chunks)
            self.ids = self.ids[: self.starts[chunks]].copy()
            self.starts = self.starts[: chunks + 1].copy()

    def _shrink(self, n: int) -> None:
        """Keeps the n chunks that came first: frequent ones come early."""
        kept = _Index()
        kept.update(islice(self.index.items(), n))
        self.index = kept

    def _split(self, text: str, plain: bool) -> list[str] | None:
        """Keys of its chunks: a chunk itself if it starts with a line end, after a return mark if it starts the text, else without its space."""
        if self.style == "drop":
            return text.split() if plain or not _odd(text) else None
        if self.style == "whole" or not plain and _odd(text) or text[:1] in _ENDS or text[-1:] in _ENDS or any(x in text for x in _DOUBLE):
            return None
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\r" + keys[0]
        return keys

    def _chunk(self, key: str) -> str:
        return key if self.style == "drop" or key[0] == "\n" else key[1:] if key[0] == "\r" else " " + key

    def _word(self, key: str) -> list[int] | None:
        """ids of a key that is one word of Latin letters, perhaps with marks after it, straight from the model; else None."""
        m = _WORD.fullmatch(key)
        if m is None or self.stop is None:
            return None
        lead, word, marks = m.groups()
        if self.style == "drop":
            if lead:
                return None
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        if self.style == "keep" and not lead:
            word = _SPACE + word
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        if lead == "\n":
            ids = [*self._piece("\n"), *ids]
        return [*ids, *self._piece(marks)] if marks else ids

    def _piece(self, text: str) -> list[int]:
        if text not in self.pieces:
            self.pieces[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.pieces[text]

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids, and how many each chunk has. Chunks are joined by a special token, where texts are cut before all else."""
        text = "".join(chunks)
        if self.stop is None or any(x in text for x in self.special):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, dtype=np.uint32) for x in lists)]), np.fromiter(map(len, lists), np.int64, len(lists))
        mark, ids, sizes = self.tokenizer.id_to_token(self.stop), [], []
        for i in range(0, len(chunks), 4096):
            got = np.asarray(self.tokenizer.encode_batch_fast([mark.join(chunks[i : i + 4096]) + mark], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(got == self.stop)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            ids.append(np.delete(got, ends))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: list[str]) -> None:
        n = len(keys)
        at = len(self.index) - n
        parts = list(map(self._word, keys))
        rest = [i for i, p in enumerate(parts) if p is None]
        if rest:
            flat, sizes = self._encode_chunks([self._chunk(keys[i]) for i in rest])
            for i, ids in zip(rest, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                parts[i] = ids.tolist()
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n)
        flat = np.fromiter(chain.from_iterable(parts), dtype=np.uint32, count=int(sizes.sum()))
        end = self.starts[at]
        while end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[end : end + len(flat)] = flat
        self.starts[at + 1 : at + n + 1] = end + np.cumsum(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end."""
        plain = not _odd("\n".join(texts))
        split = [self._split(t, plain) for t in texts]
        if None in split:
            parts, run = [], []
            for text, keys in zip([*texts, ""], [*split, None], strict=True):
                if keys is not None:
                    run.append(keys)
                    continue
                parts.append(self._of_keys(run))
                whole = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                parts.append((whole, np.array([len(whole)], dtype=np.int64)))
                run = []
            parts.pop()
            return np.concatenate([p[0] for p in parts]), np.cumsum(np.concatenate([np.diff(p[1], prepend=0) for p in parts]))
        return self._of_keys(split)

    def _of_keys(self, split: list[list[str]], again: bool = True) -> tuple[np.ndarray, np.ndarray]:
        n = sum(map(len, split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=n)
        new, self.index.new = self.index.new, []
        if again and len(self.index) > self.most_chunks:  # once only: texts at hand may have more chunks than that
            self._shrink(min(self.most_chunks // 2, len(self.index) - len(new)))
            return self._of_keys(split, False)
        if new:
            self._learn(new)
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if n else 0
        ids = self.ids[np.arange(total) + np.repeat(first - ends + sizes, sizes)]
        last = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        return ids, np.concatenate([[0], ends])[last]


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD)


class _Index(dict):
    """Numbers keys as they come, and notes the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = k = len(self)
        self.new.append(key)
        return k


def _style(spec: dict) -> str:
    """Whether chunks of white space and words are encoded each on its own, by the file's own words."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type") != "BPE" or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "keep"
    steps = pre.get("pretokenizers") or [{}]
    lossless = norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if lossless and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and "[^\\s\\p{L}\\p{N}]+" in steps[0]["pattern"].get("Regex", ""):
        return "drop"
    return "whole"


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, most_chunks: int = 900_000) -> ChunkEncoder:
    """One for each process and file; a store of 900,000 chunks takes about 200 MB."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, most_chunks)
    return _encoders[path]
