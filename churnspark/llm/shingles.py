"""Word-shingle sets as sorted 64-bit hashes (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for the last words seen (at most ``limit`` entries)."""

    limit = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle, no words as none."""
    ws = split_words(text)
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, n)
    width = min(k, n)
    m = n - width + 1
    x = np.full(m, width, np.uint64)
    for j in range(width):
        x = mix(x * _P1 + h[j:j + m])
    return np.unique(x)
