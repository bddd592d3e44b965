"""Word hashes and window hashes in numpy, for the operators that read whole texts in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)


def tidy(batches: Iterator) -> Iterator:
    """Passes batches on; when they end the worker, which stays for other tasks, returns its free memory."""
    yield from batches
    trim()


def trim() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """64-bit hashes of words; a bounded cache that starts anew when it is full."""

    def __init__(self, most: int = 80_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, seed=self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; fewer than n words have none. For small n."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(P) + h[j : j + len(out)]
    return mix(out)


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((P, P_INV)):
            p = np.full(max(n, 4096), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Like grams, in time that does not depend on n."""
    if len(h) < n:
        return h[:0]
    up, down = _powers(len(h) + 1)
    s = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=s[1:])
    return mix((s[n:] - s[:-n]) * down[: len(h) - n + 1])


def shingle_set(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes (sorted, signed) of n-word shingles; fewer words count as one shingle, no words as none."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = hashes.of(words)
    # the length keeps a short whole sequence apart from a shingle
    g = grams(h, n) if len(h) >= n else mix(grams(h, len(h)) + np.uint64(len(h)))
    return np.unique(g.view(np.int64))
