"""Sorted lists of 64-bit hashes that blocks of text send to buckets, and prefix polynomials over word hashes."""

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Polynomial:
    """Rabin-Karp over a sequence of word hashes: one prefix sum gives the hash of every run of words."""

    def __init__(self, terms: np.ndarray):
        n = len(terms)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms * powers(MULTIPLIER, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n)

    def of(self, begin: np.ndarray, size: int, seed: int) -> np.ndarray:
        """Hash of the size words from each begin on; seed tells sizes and languages apart."""
        rolled = (self.sums[begin + size] - self.sums[begin]) * self.inverse[begin]
        return mixed(rolled + np.uint64(seed))


def bounds(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where the hash ranges of the buckets begin in sorted hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(distinct, edges), [len(distinct)]))


def packed(ordered: np.ndarray) -> bytes:
    """Differences of sorted hashes by byte planes; the upper planes are nearly all zero and compress."""
    steps = np.diff(ordered, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
