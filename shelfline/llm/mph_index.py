"""A minimal perfect hash over 64-bit keys, in numpy: levels of bit arrays in which a key is placed where it hashes
alone, ranks over all bits, and a fingerprint for each slot that tells absent keys."""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * _MIX[2]
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """slots(keys) is one-to-one from the n keys it was built of onto 0 .. n-1; other keys get -1, or pass with
    probability 2**-32 when their fingerprint collides."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, prints: np.ndarray):
        self.bits, self.sizes, self.prints = bits, sizes, prints
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.cumsum(bits, dtype=np.int64) - bits  # set bits ahead of each position: its rank

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.int64), []
        while len(left):
            size = max(64, 2 * len(left))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        made = cls(bits, np.array([len(x) for x in levels], np.int64), np.zeros(len(keys), np.uint32))
        if len(keys):
            made.prints[made._raw_slots(np.asarray(keys, np.int64))] = cls.fingerprint(keys)
        return made

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mixed(np.asarray(keys), 1_000_003) >> np.uint64(32)).astype(np.uint32)

    def _raw_slots(self, keys: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.offsets[level] + (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            slots[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        got = self._raw_slots(keys)
        fits = got >= 0
        fits[fits] = self.prints[got[fits]] == self.fingerprint(keys[fits])
        return np.where(fits, got, -1)
