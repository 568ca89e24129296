"""Words and shingles of a text as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np

from .base import PIECE, pieces

BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes of substrings by prefix sums; the powers are kept from text to text."""

    def __init__(self, base: int = int(BASE)):
        self.base = base
        self.grow(1 << 12)

    def grow(self, size: int) -> None:
        base, inverse = np.uint64(self.base), np.uint64(pow(self.base, -1, 1 << 64))
        self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, base))))
        self.inverses = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, inverse))))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.powers):
            self.grow(max(2 * len(self.powers), len(raw) + 1))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.powers[:len(raw)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each raw[start:end]."""
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ of the whole text, A-Z lower-cased, in order."""
        out = []
        for piece in pieces(text, PIECE):
            raw = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
            inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
            start, end = edge[::2], edge[1::2]
            raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
            out.append(self.spans(self.sums(raw), start, end))
        return np.concatenate(out)

    def shingles(self, text: str, length: int) -> np.ndarray:
        """Sorted distinct hashes of runs of `length` words; one for all words of a shorter text, none without words."""
        words = self.words(text)
        if not len(words):
            return words
        size = min(length, len(words))
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k:len(words) - size + 1 + k]
        return np.unique(mix(rolled + np.uint64(size)))
