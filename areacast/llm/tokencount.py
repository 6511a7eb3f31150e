"""Exact token counts at every prefix of a text, by dynamic programming over words.

A byte-pair encoding is the only sequence of vocabulary tokens in which each two
neighbours, encoded together, stay as they are.  So the last token of each prefix of a
word follows from the last tokens of shorter prefixes, and its count is one more.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import inf

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.llm.packing import byte_letters
from areacast.llm.text import rows

#: Fixed value: how the word vocabulary splits a normalized text; the rest is dropped.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_REMEMBERED = 400_000


class PrefixCounter(dict):
    """Counts of a word-level byte-pair vocabulary; the mapping holds counts by word."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ends = model["end_of_word_suffix"] or ""
        self.vocab = frozenset(model["vocab"])
        self.longest = max(map(len, self.vocab))
        self.order = {
            tuple(m.split(" ") if isinstance(m, str) else m): i
            for i, m in enumerate(model["merges"])
        }
        self.made: dict[str, tuple[int, str, str]] = {}
        for (x, y), i in self.order.items():
            self.made.setdefault(x + y, (i, x, y))
        self.edges: dict[tuple[str, int], list[tuple[str, float]] | None] = {}
        self.letters = {b: c for c, b in byte_letters().items()}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = frozenset(special)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.paired: dict[tuple[str, str], bool] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        count = self[word] = self.word_prefixes(word, last_only=True)[-1]
        return count

    def _stays(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` side by side are not merged across their border."""
        known = self.paired.get((a, b))
        if known is None:
            if len(self.paired) >= 1_000_000:
                self.paired.clear()
            known = self.paired[a, b] = self._apart(a, b)
        return known

    def _edge(self, token: str, side: int) -> list[tuple[str, float]] | None:
        """Pieces at the first (0) or last (1) place of a token while it is built up.

        Each with the rank of the merge that ends it; None if merges do not build it.
        """
        key = (token, side)
        if key not in self.edges:
            pieces, rank = [(token, inf)], inf
            while (made := self.made.get(token)) and made[0] < rank:
                rank, token = made[0], made[1 + side]
                pieces.append((token, rank))
            unit = token[: len(token) - len(self.ends)] if token.endswith(self.ends) else token
            self.edges[key] = pieces[::-1] if len(unit or token) == 1 else None
        return self.edges[key]

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merge over the border comes before those that build ``a`` and ``b``.

        Of equal merges the leftmost goes first.
        """
        left, right = self._edge(a, 1), self._edge(b, 0)
        if left is None or right is None:
            return False
        p = q = 0
        while True:
            (x, x_ends), (y, y_ends) = left[p], right[q]
            rank = self.order.get((x, y), inf)
            if rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == inf:
                return True
            if x_ends <= y_ends:
                p += 1
            else:
                q += 1

    def word_prefixes(self, word: str, last_only: bool = False) -> list[int]:
        """Tokens of each prefix of ``word`` as a word of its own, by bytes."""
        s = "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        if last_only and s + self.ends in self.vocab:
            return [1]
        last, inner, whole = [""], [0], [0]
        for i in range(1, len(s) + 1):
            if not last_only or i == len(s):
                whole.append(self._step(s, i, self.ends, last, inner)[1])
            token, count = self._step(s, i, "", last, inner) if i < len(s) else ("", 0)
            last.append(token)
            inner.append(count)
        return whole

    def _step(self, s: str, i: int, end: str, last: list[str], inner: list[int]):
        """The token that ends prefix ``i``, and the count up to it."""
        for j in range(max(0, i - self.longest), i):
            token = s[j:i] + end
            if token in self.vocab and (j == 0 or (last[j] and self._stays(last[j], token))):
                return token, inner[j] + 1
        return "", 0

    def segments(self, text: str) -> Iterator[str]:
        """Words of the normalized text; special strings stand for themselves."""
        for part in self.at_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield part
            elif part:
                yield from WORDS.findall(normalized(part))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return sum(map(self.__getitem__, WORDS.findall(normalized(text))))
        return sum(1 if w in self.special else self[w] for w in self.segments(text))

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of the first 0, 1, 2, ... words of the text."""
        per_word = (1 if w in self.special else self[w] for w in self.segments(text or ""))
        return list(accumulate(per_word, initial=0))

    def fitting(self, text: str | None, budget: int) -> tuple[int, int]:
        """Words that fit into ``budget`` tokens, and bytes of the next one that still do."""
        counts = self.prefixes(text)
        n = bisect_right(counts, budget) - 1
        if n == len(counts) - 1:
            return n, 0
        word = list(self.segments(text))[n]
        inside = [0] if word in self.special else self.word_prefixes(word)
        return n, max(i for i, c in enumerate(inside) if counts[n] + c <= budget)


def normalized(text: str) -> str:
    """Composed form, lower case letter by letter."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    budget: int = 2048,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, words_in_budget`` for every row of ``docs``.

    ``words_in_budget`` is the longest run of leading words with at most ``budget``
    tokens, read off the counts of the prefixes.  A missing or empty text has none of
    anything; ids may be missing or repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        c = counter(tokenizer)
        out = []
        for key, t in rows(batches):
            n = c.count(t)
            kept = bisect_right(c.prefixes(t), budget) - 1 if n > budget else None
            out.append((key, len(t.encode("utf-8")) if t else 0, n, n > budget, kept))
            if len(out) >= 2048:
                yield _count_rows(out)
                out = []
        if out:
            yield _count_rows(out)

    return (
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        .mapInArrow(
            run, "id long, n_bytes long, n_tokens long, over_limit boolean, words_in_budget long"
        )
        .withColumnRenamed("id", id)
    )


def _count_rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    names = ("id", "n_bytes", "n_tokens", "over_limit", "words_in_budget")
    columns = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )
