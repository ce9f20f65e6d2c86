"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (shifts and two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint64)
_BYTES[65:91] += np.uint64(32)  # A-Z count as a-z
_BYTES = mix(_BYTES + np.uint64(_M))
_held: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier and its inverse to the powers 0..n, modulo 2 ** 64."""
    if len(_held.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            row = np.full(size, np.uint64(base), dtype=np.uint64)
            row[0] = 1
            _held[name] = np.cumprod(row, dtype=np.uint64)
    return _held["up"][: n + 1], _held["down"][: n + 1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (other than ASCII white space, A-Z in lower case) of all texts in a row, and the text of each."""
    flat = np.frombuffer(b"\n".join([*(t.encode("utf-8", "surrogatepass") for t in texts), b""]), dtype=np.uint8)
    blank = np.concatenate([[True], _SPACE[flat], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(flat))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[flat] * up[:-1], dtype=np.uint64)])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 if not t.isascii() else len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return hashed, np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed k-word shingles of each text, ascending, all in a row; and how many each text has.

    A text of fewer words has one shingle, of all of them; one without words has none.
    """
    n = len(texts)
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=n)
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(_M) + words[j : len(words) - k + 1 + j]
        rolled = mix(rolled + np.uint64(k))
    start = np.cumsum(counts) - counts
    for i in range(n):
        a, c = int(start[i]), int(counts[i])
        if not c:
            continue
        if c >= k:
            own = np.sort(rolled[a : a + c - k + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a : a + c]:
                h = h * np.uint64(_M) + w
            own = mix(h + np.uint64(c))
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), sizes
