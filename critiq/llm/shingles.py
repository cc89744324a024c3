"""Word shingles of whole texts as 64-bit hashes, in numpy.

A batch of texts is one byte buffer (Arrow's own), so words are found and hashed
with array operations instead of a Python loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes hashed at once; only a longer single text makes a larger piece
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte after lower-casing A-Z, and which bytes are white space."""
    value = seeded(256, 11)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return value, space


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of its text. starts: ascending offsets of the texts in data."""
    n = len(data)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64)
    value, space = _tables()
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)  # a text begins here: no word crosses it
    edge[starts[starts <= n]] = True
    before = np.concatenate(([False], inside[:-1]))
    first = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate((inside[1:], [False]))
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(max(PIECE, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, U64)
    np.cumsum(value[data] * up[:n], out=total[1:])
    h = (total[last] - total[first]) * down[first] + (last - first).astype(U64)
    return mix(h), np.searchsorted(starts, first, side="right") - 1


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of ``width`` words.

    Fewer words: the whole sequence is the one shingle. Null or without words: empty.
    """
    texts = texts.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + sizes[upto] <= PIECE):
            total += sizes[upto]
            upto += 1
        yield from _sets(texts.slice(at, upto - at), width)
        at = upto


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
    words, owner = word_hashes(data, offsets[:-1] - offsets[0])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rolled = _combine([words[j : len(words) - width + 1 + j] for j in range(width)]) if len(words) >= width else words[:0]
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if a == b or not valid[i]:
            yield np.empty(0, U64)
        elif b - a < width:
            yield _combine([words[j : j + 1] for j in range(a, b)])
        else:
            x = np.sort(rolled[a : b - width + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), U64)
    for p in parts:
        h = mix(h + p)
    return h


def set_key(x: np.ndarray) -> bytes:
    """Equal for equal sets only (128 bits)."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def signature(x: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signature of a non-empty set: the upper 32 bits of each coordinate's minimum."""
    add, times = seeded(coordinates, 101), seeded(coordinates, 202) | U64(1)
    out = np.full(coordinates, np.iinfo(np.uint64).max, U64)
    for a in range(0, len(x), 2048):
        np.minimum(out, ((x[a : a + 2048, None] ^ add) * times).min(axis=0), out=out)
    return (out >> U64(32)).astype(np.uint32)
