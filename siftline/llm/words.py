"""Words and hashes of words, vectorised over a batch of texts inside a Python worker."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """word -> 64-bit hash; hashing happens once for each word that a worker meets."""

    LIMIT = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashes(tokens: list[str], known: Vocabulary) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries; none if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = out * GOLDEN + h[i : i + n]
    return mixed(out)


def shingles(text: str | None, k: int, known: Vocabulary) -> np.ndarray:
    """The sorted set of hashes of k consecutive words."""
    return np.unique(windows(hashes(words(text), known), k)) if text else np.empty(0, np.uint64)
