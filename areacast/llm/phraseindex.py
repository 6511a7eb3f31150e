"""A bidirectional FM-index of word numbers: intervals of phrases, extended either way."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class _Side:
    """One direction: suffixes sorted by their first ``depth`` symbols, and their BWT."""

    def __init__(self, text: np.ndarray, alphabet: int, depth: int):
        n = len(text)
        key = text.astype(np.int64)
        for j in range(1, depth):
            key = key * alphabet + np.roll(text, -j)
            if alphabet ** (j + 2) >= 2**63 and j + 1 < depth:
                key = np.unique(key, return_inverse=True)[1]
        order = np.argsort(key, kind="stable")
        #: The symbol before each suffix, in the order of the suffixes.
        self.bwt = text[order - 1]
        self.size = n

    @cached_property
    def last_to_first(self) -> np.ndarray:
        """Where the suffix that starts one symbol earlier stands."""
        out = np.empty(self.size, np.int64)
        out[np.argsort(self.bwt, kind="stable")] = np.arange(self.size)
        return out


class PhraseIndex:
    """Phrases of a text of word numbers from 1 on, in which 0 ends a piece.

    A phrase is a pair of intervals: of the suffixes that start with it, and of those of
    the reversed text that start with its reverse.  Suffixes are sorted by ``longest`` - 1
    symbols, which is all that enumerating phrases of up to ``longest`` words asks for.
    """

    def __init__(self, text: np.ndarray, alphabet: int, longest: int):
        text = np.concatenate([[0], text, [0]]).astype(np.int32)
        self.alphabet = alphabet
        depth = max(1, longest - 1)
        self._text, self._depth = text, depth
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=alphabet)))

    @cached_property
    def _forward(self) -> _Side:
        return _Side(self._text, self.alphabet, self._depth)

    @cached_property
    def _backward(self) -> _Side:
        return _Side(self._text[::-1], self.alphabet, self._depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, forward and backward start, and count of each word."""
        counts = np.diff(self.first)
        there = np.flatnonzero(counts[1:]) + 1
        return there, self.first[there], self.first[there], counts[there]

    def right(self, forward: np.ndarray, backward: np.ndarray, count: np.ndarray, last: bool = False):
        """Phrases by one word more behind: parent, word, forward and backward start, count.

        ``last`` leaves the starts out, for phrases that are not extended.
        """
        return self._extended(self._backward, backward, forward, count, last)

    def left(self, forward: np.ndarray, backward: np.ndarray, count: np.ndarray, last: bool = False):
        """Phrases by one word more in front, as ``right``."""
        parent, word, back, front, n = self._extended(self._forward, forward, backward, count, last)
        return parent, word, front, back, n

    def _extended(self, side: _Side, own: np.ndarray, other: np.ndarray, count: np.ndarray, last: bool):
        """Children by the symbols in front of the suffixes of ``side`` in each interval.

        Returns parent, symbol, the start on the other side and on this one, and count.
        """
        parent = np.repeat(np.arange(len(own)), count)
        skip = np.cumsum(count) - count
        at = np.arange(len(parent)) + np.repeat(own - skip, count)
        key = parent * np.int64(self.alphabet) + side.bwt[at]
        if last:
            key = np.sort(key)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            front = back = np.zeros(0, np.int64)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            # The first of a child's places maps to its start; smaller symbols of the
            # same parent come before it on the other side.
            back = side.last_to_first[at[order[first]]]
            front = other[parent[first]] + first - skip[parent[first]]
        parent, symbol = key[first] // self.alphabet, key[first] % self.alphabet
        n = np.diff(np.append(first, len(key)))
        kept = symbol > 0
        if last:
            return parent[kept], symbol[kept], front, back, n[kept]
        return parent[kept], symbol[kept], front[kept], back[kept], n[kept]
