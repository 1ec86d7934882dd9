"""A minimal perfect hash in the style of BBHash (Limasset et al. 2017).

Level by level, every key that is left hashes into a bit array twice as long as there are
keys; a bit that one key alone hits is its own, the others go on. The place of a key is the
number of ones before its bit, over all levels: 0 to n - 1 without a gap, in about three
bits a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ocelens.llm.words import GOLDEN, mix

_GAMMA, _MOST_LEVELS = 2, 64


def _position(keys: np.ndarray, salts: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + mix(salts + GOLDEN * np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Bit arrays, one after another in bytes, and their lengths in bits."""

    sizes: tuple[int, ...]
    bits: bytes

    @classmethod
    def build(cls, keys: np.ndarray, salts: np.ndarray) -> PerfectHash:
        """For distinct pairs of 64-bit numbers (key, salt)."""
        sizes, parts = [], []
        while len(keys):
            if len(sizes) == _MOST_LEVELS:
                raise ValueError("two keys have the same two hashes")
            size = max(64, -(-_GAMMA * len(keys) // 64) * 64)
            at = _position(keys, salts, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            sizes.append(size)
            parts.append(np.packbits(hits == 1, bitorder="little").tobytes())
            left = hits[at] > 1
            keys, salts = keys[left], salts[left]
        return cls(tuple(sizes), b"".join(parts))

    def places(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """The place of each key; any place, or -1, for a key that is not in the set."""
        bits = np.unpackbits(np.frombuffer(self.bits, np.uint8), bitorder="little")
        before = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _position(keys[open_], salts[open_], level, size)
            hit = bits[at] == 1
            out[open_[hit]] = before[at[hit]]
            open_, base = open_[~hit], base + size
        return out
