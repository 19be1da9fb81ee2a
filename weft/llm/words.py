"""Vectorised words and word n-grams of Arrow string arrays.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D.  Those bytes never occur inside a
multi-byte UTF-8 sequence, so splitting bytes splits code points alike.  Hashes are 64 bit: a random
value per byte times a power of an odd base, summed modulo 2**64 and then mixed.  They depend on the
word alone, never on its place, its batch or the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        a = np.full(size, base, U)
        a[0] = 1
        _powers[base] = have = np.cumprod(a, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """Words of the texts of one slice: byte spans, hashes, and the first word of every text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data, self.off = data, off
        n = len(data)
        inside = ~_SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[off[:-1][off[:-1] < n]] = False
            after[off[1:][off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.n_words = np.diff(self.first)
        total = np.zeros(n + 1, U)
        np.cumsum((_LOWER if lower else _VALUE)[data] * _power(_BASE, n), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INVERSE, n + 1)[self.start])

    def grams(self, k: int, seed: int = 1) -> np.ndarray:
        """Hash of the k words from each word on, across texts too; see starts()."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, U)
        for j in range(k):
            out = out * U(0xC2B2AE3D27D4EB4F) + self.hash[j : j + n]
        return mix(out + U(seed))

    def starts(self, k: int) -> np.ndarray:
        """First words of the k-grams that lie within one text."""
        last = np.repeat(self.first[1:], self.n_words) - k
        return np.flatnonzero(np.arange(len(last)) <= last)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, "right") - 1


def slices(arr: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes, one text at least."""
    data, off = flat(arr)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
