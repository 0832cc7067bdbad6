"""Words and word sequences of texts, hashed in whole Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: One Chinese character, or a run of other letters, digits and underscores.
WORD = re.compile("[一-鿿]|[^\\W一-鿿]+")

#: Words a task remembers the hashes of; a full memory is emptied, never a reason to skip a word.
REMEMBERED = 1_000_000


class WordHashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def hashed_words(texts: list[str], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts in a row, and the number of words of each text."""
    flat: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        counts[i] = len(words)
        flat += words
    return np.fromiter(map(memory.__getitem__, flat), dtype=np.uint64, count=len(flat)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values end far apart."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words of each text, in a row, and where each text's begin.

    Every text needs at least ``width`` words.
    """
    ends = np.cumsum(counts)
    n = len(words) - width + 1
    value = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    inside = np.ones(max(n, 0), dtype=bool)
    for k in range(1, width):  # a sequence may not begin in one text and end in the next
        at = ends[:-1] - k
        inside[at[at < n]] = False
    starts = np.concatenate([[0], np.cumsum(counts - width + 1)[:-1]]).astype(np.int64)
    return mix(value[inside]), starts
