"""Hashes of words, and sorted arrays of 64-bit hashes with values."""

from __future__ import annotations

import numpy as np

SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that the index is over.
INDEX = 20
#: Words whose hashes a task holds.
HELD = 300_000


class HashArray:
    """Distinct keys by a hash, in its order, with the values of each; a last value of 0 stands for a missing key."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashes = keys * SPREAD
        order = np.argsort(hashes)
        self.n = len(keys)
        self.hashes = hashes[order]
        self.values = [np.append(v[order], v.dtype.type(0)) for v in values]
        self.starts: np.ndarray | None = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, n for a missing one."""
        n = self.n
        if n == 0:
            return np.zeros(len(keys), np.int32)
        if self.starts is None:  # made once in a worker
            self.starts = np.searchsorted(self.hashes, np.arange(1 << INDEX, dtype=np.uint64) << np.uint64(64 - INDEX)).astype(np.int32)
        hashes = keys * SPREAD
        at = self.starts[hashes >> np.uint64(64 - INDEX)]
        np.minimum(at, n - 1, out=at)
        seen = self.hashes[at]
        left = np.flatnonzero(seen < hashes)
        while len(left):
            at[left] += 1
            left = left[at[left] < n]
            seen[left] = self.hashes[at[left]]
            left = left[seen[left] < hashes[left]]
        np.minimum(at, n - 1, out=at)
        at[self.hashes[at] != hashes] = n
        return at


class Hashes(dict):
    """XXH64 of words, remembered up to HELD words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= HELD:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
