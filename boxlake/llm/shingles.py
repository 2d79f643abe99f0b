"""Word shingles as 64-bit hashes, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 100_000
WIDTH = 5


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; bytes' own methods leave all other characters alone."""
    return text.encode().lower().split()


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes (uint64) of all runs of ``width`` words; fewer words: of the whole sequence; no words: none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    count = len(words) - n + 1
    value = np.full(count, n, np.uint64)
    for i in range(n):
        value = _finish(value + hashes[i : i + count])
    return np.unique(value)
