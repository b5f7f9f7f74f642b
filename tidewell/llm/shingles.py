"""Word shingles as 64-bit hashes, in numpy: the sets that near-duplicate search compares."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Odd multipliers for the words of a shingle, and those of the usual 64-bit finaliser.
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


class WordHashes(dict):
    """Hash of a word, remembered for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased. bytes.split() separates at the six ASCII spaces only."""
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(text: bytes, width: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingles of ``width`` words; the whole sequence where there are fewer; none without words."""
    h = word_hashes(text, known)
    if not len(h):
        return h
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out + h[k : len(h) - size + 1 + k] * _STEPS[k % 4] + np.uint64(k // 4))
    return np.unique(out)
