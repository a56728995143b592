"""Words of a text and their 64-bit hashes, for the Arrow steps of several operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Known words kept per worker; the memory of a worker stays bounded on any corpus.
CACHED_WORDS = 500_000

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordHashes(dict):
    """Hash of each word (bytes); words seen before are looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def text_words(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII white-space characters; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a 64-bit finalizer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])


class RangeHashes:
    """Hash of any word range of one text, from prefix sums of ``hash * base ** position``."""

    def __init__(self, hashes: np.ndarray, powers: Powers) -> None:
        n = len(hashes)
        powers.grow(n + 1)
        self.powers = powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers.up[:n], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Hash of each window of ``k`` words; empty when there are fewer."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[: n - k + 1]) * self.powers.down[: n - k + 1])

    def windows_at(self, start: np.ndarray, k: int) -> np.ndarray:
        """Hash of the windows of ``k`` words that begin at ``start``."""
        return mixed((self.sums[start + k] - self.sums[start]) * self.powers.down[start])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words ``start <= i < stop`` of each pair, its length included."""
        value = (self.sums[stop] - self.sums[start]) * self.powers.down[start]
        return mixed(value + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
