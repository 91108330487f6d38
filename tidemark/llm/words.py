"""Words of many texts at once as numpy arrays: bounds and 64-bit hashes by prefix sums, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: An odd multiplier has an inverse modulo 2**64, so a prefix sum of byte * BASE**i gives every word's polynomial.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken together up to so many bytes; arrays of this size stay in the processor's cache.
BLOCK = 1 << 19


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of texts that hold about `limit` bytes together; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bounds(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table `inside` is true."""
    is_word = np.empty(len(data) + 2, dtype=np.int8)
    is_word[0] = is_word[-1] = 0
    is_word[1:-1] = inside[data]
    edges = np.flatnonzero(np.diff(is_word))
    return edges[0::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = 1 << max(16, len(data).bit_length())
    up, down = powers(n)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row; the i-th starts at word i."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(BASE) + h[k : len(h) - n + 1 + k])
    return out
