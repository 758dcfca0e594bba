"""MinHash signatures and bands over 64-bit shingle hashes, and exact set overlap."""

from __future__ import annotations

import numpy as np

from lodegraph.llm import textkernel as K

U32, U64 = np.uint32, np.uint64


class MinHasher:
    """``bands * rows`` permutations of 32-bit hashes (multiplication by fixed odd numbers)."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        self.a = (K.splitmix(bands * rows, seed) >> U64(32)).astype(U32) | U32(1)

    def signatures(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One signature for each row that has hashes; row r owns ``hashes[first[r]:first[r+1]]``. Repeats do not matter."""
        starts = first[:-1][first[:-1] < first[1:]]
        out = np.empty((len(self.a), len(starts)), dtype=U32)
        if len(starts):
            x = (hashes[starts[0] : first[-1]] >> U64(16)).astype(U32)
            starts = starts - starts[0]
            tmp = np.empty_like(x)
            for k, a in enumerate(self.a):
                np.multiply(x, a, out=tmp)
                np.minimum.reduceat(tmp, starts, out=out[k])
        return out.T

    def band_keys(self, sigs: np.ndarray) -> np.ndarray:
        """A 32-bit key for each band of each signature."""
        x = np.ascontiguousarray(sigs).reshape(len(sigs), self.bands, self.rows).astype(U64)
        key = np.zeros(x.shape[:2], dtype=U64)
        for j in range(self.rows):
            key = K.mix(key * U64(0xA0761D6478BD642F) + x[:, :, j])
        return (key >> U64(32)).astype(U32)

    def miss(self, similarity: float) -> float:
        """Chance that a pair of this similarity shares no band."""
        return (1 - similarity**self.rows) ** self.bands


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def posterior_floor(total: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each batch end n the fewest agreements m with P(similarity >= threshold | m of n) >= miss under a uniform prior.

    With a Beta(m+1, n-m+1) posterior that probability is P(Binomial(n+1, threshold) <= m).
    """
    from math import comb

    out = []
    for n in range(step, total + 1, step):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out
