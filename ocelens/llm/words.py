"""Words of a text and hashes of their windows."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run without ASCII white space, taken as it is.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_REMEMBERED = 300_000  # word hashes per worker


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters neighbours."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(one: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` consecutive words; none if there are fewer."""
    n = len(one) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: hashes of 2^k words, joined to windows of any size
    total, done, power, width = np.zeros(n, np.uint64), 0, one, 1
    while True:
        if size & width:
            total = mix(total * GOLDEN + power[done : done + n])
            done += width
        if done == size:
            return total
        power = mix(power[:-width] * GOLDEN + power[width:])
        width *= 2
