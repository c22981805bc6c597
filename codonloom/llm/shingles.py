"""Word shingles and MinHash, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64; kept, at most twice the longest asked for."""
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(2 * n, 4096), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def normalised(text: str) -> str:
    """Lower-cased words, one space between them."""
    return " ".join(text.lower().split())


def word_hashes(norm: str) -> np.ndarray:
    if not norm:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(norm.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.append(np.flatnonzero(b == 32), len(b))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)))])
    return mix((sums[ends] - sums[starts]) * powers(BACK, len(b))[starts] + (ends - starts).astype(np.uint64))


def shingles(norm: str, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each run of ``words`` words; a shorter text is one shingle of
    all its words, one without words has none."""
    w = word_hashes(norm)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(BASE) + w[i : i + n]
    return mix(h + np.uint64(k))


class MinHash:
    """``bands`` bands of ``rows`` minima, seeded."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def minima(self, h: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(h), 1024):
            x = self.a[:, None] * h[None, at : at + 1024]
            x += self.b[:, None]
            np.minimum(low, x.min(axis=1), out=low)
        return low

    def signature(self, h: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A signed 64-bit hash for each band, and a byte of each minimum."""
        low = self.minima(h) >> np.uint64(32)
        bands = np.arange(self.bands, dtype=np.uint64)
        for col in low.reshape(self.bands, self.rows).T:
            bands = mix(bands * np.uint64(BASE) + col)
        return bands.astype(np.int64), (low & np.uint64(255)).astype(np.uint8).tobytes()
