"""Word and shingle hashes of whole texts, vectorised per document."""

from __future__ import annotations

import numpy as np
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(32), np.uint64(29)

#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 200_000


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _A
    x = (x ^ (x >> _S2)) * _B
    return x ^ (x >> _S1)


def words_of(text: str) -> list[bytes]:
    """Runs between space and the five ASCII control blanks, A-Z lower-cased (bytes.lower and bytes.split do just that)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of the whole sequence if it has fewer words."""
    words = words_of(text) if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = acc * _A + h[i : n - width + 1 + i]
        acc ^= acc >> _S2
    return np.unique(mix(acc))
