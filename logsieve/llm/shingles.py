"""Word-shingle sets and minwise sketches of Arrow string columns, with numpy.

Words are runs of non-separators after lower-casing A-Z; a shingle is ``k``
consecutive words, a text of fewer words is one shingle. Shingles are 64-bit
hashes of 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tokens import blocks, raw

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end) of a buffer."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    value = _BYTE[_FOLD[b]]
    value[~inside] = 0
    place = np.arange(len(b), dtype=np.int64)
    place -= np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else np.concatenate(
        [np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(b))))]
    )
    value = mix(value + (place.astype(np.uint64) + np.uint64(1)) * _STEP)
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, start) + _STEP)
    return hashes, np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of a block without nulls."""
    words, bounds = word_hashes(*raw(texts))
    turns = [np.uint64(pow(int(_STEP), i + 1, 1 << 64)) for i in range(k)]
    n = len(words)
    if n >= k:
        grams = words[: n - k + 1] * turns[0]
        for i in range(1, k):
            grams = grams + words[i : n - k + 1 + i] * turns[i]
        grams = mix(grams)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= k:
            yield np.unique(grams[a : z - k + 1])
        elif z > a:
            whole = np.array([z - a], np.uint64)
            for w in words[a:z]:
                whole = mix(whole * _STEP + w)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """As shingle_sets, of any string array; nulls count as empty."""
    for block in blocks(texts.fill_null("")):
        yield from shingle_sets(block, k)


def minwise_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    source = np.random.Generator(np.random.PCG64(7))
    return (
        source.integers(0, 2**64 - 1, n, dtype=np.uint64)[:, None],
        source.integers(0, 2**63 - 1, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1),
    )


def minwise(shingles: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest hash of a set under each key; a set of any size in bounded memory."""
    flips, factors = keys
    best = None
    step = max(64, _CHUNK // len(flips) * 8)
    for at in range(0, len(shingles), step):
        low = ((shingles[at : at + step] ^ flips) * factors).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
