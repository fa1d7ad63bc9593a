"""64-bit hashes in numpy, used inside tasks.  The same input gives the same hash in every process."""
from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_STEP, _A, _B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a bijection)."""
    x = x + _STEP
    x = (x ^ (x >> U64(30))) * _A
    x = (x ^ (x >> U64(27))) * _B
    return x ^ (x >> U64(31))


def chain(parts) -> np.ndarray:
    """Hash of a sequence of equally long arrays, element by element; order matters."""
    h = None
    for p in parts:
        h = mix(p) if h is None else mix(h ^ p)
    return h


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per word; forgets everything beyond ``limit`` words."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))
