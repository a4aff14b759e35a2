"""Hashes of the words of UTF-8 texts, straight from Arrow's buffers.

Word boundaries are ASCII bytes, so that bytes serve as well as characters and
numpy handles many texts at once. Texts longer than a block go through in pieces
cut at word boundaries; the pieces' words come out as one text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64
#: Odd multiplier of the polynomial over a word's bytes.
BASE = U(0x9E3779B97F4A7C15)
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALPHANUMERIC = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER] | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i below n."""
    up, down = np.ones(n, U), np.ones(n, U)
    up[1:], down[1:] = BASE, U(pow(int(BASE), -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def hashed_block(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts between ``offsets``, and each text's number of words."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    n, texts = hi - lo, len(offsets) - 1
    if not n:
        return np.zeros(0, U), np.zeros(texts, np.int64)
    piece = data[lo:hi]
    inside = ~separators[piece]
    cuts = (offsets - lo)[:-1]
    cuts = cuts[cuts < n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    inner = cuts[cuts > 0]
    ends[inner] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = powers(BLOCK if n <= BLOCK else 1 << (n - 1).bit_length())
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(VALUES[piece] * up[:n], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return hashes, np.diff(np.searchsorted(start, offsets - lo))


def word_hashes(column: pa.Array, separators: np.ndarray = WHITE_SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words' hashes, words of each row), all rows in order."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        if offsets[last] - offsets[row] <= BLOCK:
            yield row, last, *hashed_block(data, offsets[row : last + 1], separators)
        else:
            at, end, parts = int(offsets[row]), int(offsets[row + 1]), []
            while at < end:
                size, to = BLOCK, end
                while end - at > size:
                    gaps = np.flatnonzero(separators[data[at + size // 2 : at + size]])
                    if len(gaps):
                        to = at + size // 2 + int(gaps[-1]) + 1
                        break
                    size *= 2
                parts.append(hashed_block(data, np.array([at, to]), separators)[0])
                at = to
            words = np.concatenate(parts)
            yield row, row + 1, words, np.array([len(words)])
        row = last


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``size`` words, sorted, and how many it has.

    A text of fewer words is one shingle; one without words has none.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - (np.cumsum(counts) - counts)[rows]
    left = counts[rows] - place
    shingles = mixed(words)
    for k in range(1, size):
        after = np.zeros_like(words)
        after[:-k] = words[k:]
        shingles = np.where(left > k, mixed(shingles * U(0xD6E8FEB86659FD93) + after), shingles)
    keep = (left >= size) | (place == 0)
    shingles, rows = shingles[keep], rows[keep]
    edges = np.searchsorted(rows, np.arange(len(counts) + 1))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        shingles[i:j].sort()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
    return shingles[fresh], np.bincount(rows[fresh], minlength=len(counts))
