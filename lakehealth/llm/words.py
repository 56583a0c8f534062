"""Words, word hashes and five-word shingles, the same in every task."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import xxhash

#: Words are runs of letters, digits and underscores of the lower-cased text.
find_words = re.compile(r"\w+").findall
#: Words of a shingle.
SHINGLE = 5
#: Entries of a worker's word cache. When it is full, its older half stays: what is met first is frequent.
CACHE_WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


class WordHash(dict):
    """word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            kept = dict(islice(self.items(), CACHE_WORDS // 2))
            self.clear()
            self.update(kept)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * MIX2
    return h ^ (h >> np.uint64(27))


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    s = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        s = mix(s * MIX + hashes[j:n - width + 1 + j])
    return np.unique(s)
