"""An FM-index of word segments: backward search over a wavelet matrix of bit vectors."""

from __future__ import annotations

import numpy as np


#: For each number below 64, that many low bits.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


#: Positions searched together: few enough for a core's cache.
_BLOCK = 1 << 16


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        size = (len(bits) >> 6) + 1
        padded = np.zeros(size * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.append(0, ones[:-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & _BELOW[i & 63])


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of the symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.zeros = [], []
        now, first = symbols, np.zeros(alphabet, np.int64)
        every = np.arange(alphabet)
        for level in range(self.levels):
            shift = self.levels - 1 - level
            bit = (now >> shift) & 1 == 1
            vector, zeros = BitVector(bit), int(len(bit) - bit.sum())
            self.bits.append(vector)
            self.zeros.append(zeros)
            first = self._down(vector, zeros, (every >> shift) & 1 == 1, first)
            now = np.concatenate([now[~bit], now[bit]])
        self.first = first

    @staticmethod
    def _down(vector: BitVector, zeros: int, right: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = vector.ones(i)
        return np.where(right, ones + zeros, i - ones)

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol is among the first ``i``, for each ``i`` of ``ends``."""
        for level in range(self.levels):
            right = (symbol >> (self.levels - 1 - level)) & 1 == 1
            ends = [self._down(self.bits[level], self.zeros[level], right, i) for i in ends]
        first = self.first[symbol]
        return [i - first for i in ends]


class SegmentIndex:
    """FM-index of segments, each ended by a sentinel of its own.

    Suffixes are sorted by their first ``depth`` words; patterns may have so many.
    Those that start with one pattern stand together, and as many before them precede a
    word's own as in a full sort, so steps of the backward search are the same.
    """

    def __init__(self, segments: list[np.ndarray], depth: int):
        sizes = np.array([len(s) for s in segments])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        words, ids = np.unique(np.concatenate(segments), return_inverse=True)
        size = int((sizes + 1).sum())
        self.text = np.zeros(size, np.int64)
        inside = np.ones(size, bool)
        inside[self.starts + sizes] = False
        self.text[inside] = ids + 1
        self.owner = np.repeat(np.arange(len(segments)), sizes + 1)
        self.suffixes = self._sorted(inside, len(segments), depth)
        self.before = WaveletMatrix(self.text[self.suffixes - 1], len(words) + 1)
        counts = np.bincount(self.text, minlength=len(words) + 1)
        self.smaller = np.append(0, np.cumsum(counts))

    def _sorted(self, inside: np.ndarray, segments: int, depth: int) -> np.ndarray:
        """All suffixes in the order of their first ``depth`` words, or of more.

        Each pass sorts by the ranks of two or, where these fit into 63 bits, three
        parts, whose words the pass before has sorted.
        """
        n = len(self.text)
        rank = np.where(inside, self.text + segments, self.owner)
        base, sorted_words = n + 1, 1
        parts = 3 if base**3 < 1 << 63 else 2
        while True:
            key = rank.copy()
            for part in range(1, parts):
                key *= base
                shift = part * sorted_words
                key[: max(0, n - shift)] += rank[shift:] + 1
            order = np.argsort(key)
            key = key[order]
            new = np.append(False, key[1:] != key[:-1])
            sorted_words *= parts
            if sorted_words >= min(depth, n) or new[1:].all():
                return order
            rank[order] = np.cumsum(new)

    def matches(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the indexed positions ``at``, up to ``size`` words.

        Extends the pattern that ends ``size`` words on to the left, word by word, as
        long as it stands in more than one place.  Returns the number of words matched
        and the range of suffixes that start with the whole pattern; the range is
        empty for patterns that stand in one place alone.
        """
        low, high, length = (np.zeros(len(at), np.int64) for _ in range(3))
        for first in range(0, len(at), _BLOCK):
            block = slice(first, first + _BLOCK)
            self._search(at[block], size, low[block], high[block], length[block])
        return length, low, high

    def _search(self, at, size: int, low, high, length) -> None:
        live = np.arange(len(at))
        for j in range(size - 1, -1, -1):
            symbol = self.text[at[live] + j]
            a, z = self.smaller[symbol], self.smaller[symbol + 1]
            if j < size - 1:
                a, z = (a + r for r in self.before.rank(symbol, low[live], high[live]))
            kept = z - a >= 2
            low[live], high[live] = a, np.where(kept, z, a)
            live = live[kept]
            length[live] += 1

    def smallest(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Smallest ``values`` of the segments that own the suffixes of each range.

        Ranges are those of patterns of one length: equal or apart.
        """
        starts, which = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[which] = high
        owned = np.append(values[self.owner[self.suffixes]], np.iinfo(np.int64).max)
        cuts = np.stack([starts, ends], axis=1).ravel()
        return np.minimum.reduceat(owned, cuts)[::2][which]
