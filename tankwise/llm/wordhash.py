"""Word hashes of Arrow text batches with numpy: no Python object for a word or a shingle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: A random 64-bit value for each byte.
_OF_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of rows lo to hi of a batch: hashes, the row of each (from 0), and where each row's words begin (n + 1)."""

    lo: int
    hi: int
    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(texts: pa.Array, lower: bool = False, at_once: int = 1 << 21, between: np.ndarray = _SPACE) -> Iterator[Words]:
    """Hashes of the runs without white space (or without the bytes marked in between) in each text, some megabytes of rows at a
    time; null has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + at_once, "right")) - 1)
        own = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        full = ~between[part]
        size = len(full)
        starts, ends = full.copy(), full.copy()
        starts[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        inner = own[1:-1]
        inner = inner[(inner > 0) & (inner < size)]
        starts[inner] |= full[inner]
        ends[inner - 1] |= full[inner - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        up, down = _power(size + 1)
        sums = np.zeros(size + 1, _U)
        np.cumsum(_OF_BYTE[_LOWER[part] if lower else part] * up[:size], out=sums[1:])
        hashes = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
        first = np.searchsorted(s, own)
        yield Words(lo, hi, hashes, np.repeat(np.arange(hi - lo), np.diff(first)), first)
        lo = hi


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie in one row, and the index of their first word."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    h = w.hashes[at]
    for j in range(1, k):
        h = h * _U(_BASE) + w.hashes[at + j]
    return mix64(h), at


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of k-word shingles, A-Z in lower case; fewer words make one shingle."""
    for w in words(texts, lower=True):
        h, at = grams(w, k)
        bounds = np.searchsorted(at, w.first)
        for i in range(w.hi - w.lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                own = np.sort(h[bounds[i] : bounds[i + 1]])
                fresh = np.ones(len(own), bool)
                fresh[1:] = own[1:] != own[:-1]
                yield own[fresh]
            elif b > a:
                x = w.hashes[a : a + 1]
                for j in range(a + 1, b):
                    x = x * _U(_BASE) + w.hashes[j : j + 1]
                yield mix64(x + _U(b - a))
            else:
                yield np.zeros(0, _U)
