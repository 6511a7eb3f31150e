"""Small tables with the awkward rows, and plain definitions to compare with."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "node long, id string, shard int, mix_size string, lang_pred string, t int, rank int"
)
SPACES = re.compile("[^\x20\x09-\x0d]+")


def rows(seed: int = 3) -> list[tuple]:
    """Nulls everywhere, empty and long texts, repeated rows, copies, clashing columns."""
    r = random.Random(seed)
    vocabulary = {
        "en": "the of and to in is that river house stone walks green under morning".split(),
        "de": "der die und in den von ist haus fluss stein geht grün unter morgen".split(),
    }

    def prose(lang: str, n: int) -> str:
        return " ".join(r.choice(vocabulary[lang]) + r.choice(["", "", str(r.randrange(50))]) for _ in range(n))

    base = prose("en", 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:40]) + " " + prose("en", 100)
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, prose("de", 20_000), "de", "b"),
        (10, base, "en", "a"),
        (11, base, "en", None),
        (11, base, "en", None),
        (12, near, "en", "b"),
        (13, far, None, "b"),
        (14, base.upper(), "en", "c"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (15, "one two", "en", "a"),
        (16, "ONE two", "en", "a"),
        (17, "12 34 -- 56", None, None),
        (18, "Σίγμας İx y <|endoftext|> don't ÄÖß é 日本語\x1f 'll it's 2024", "de", "c"),
        (19, "line a\nline b\nline a\n\nline a", "en", "c"),
        (20, "la " * 3000, "de", "b"),
    ]
    texts += [(100 + i, prose(("en", "de")[i % 2], 30 + i), ("en", "de")[i % 2], "abc"[i % 3]) for i in range(40)]
    return [(*t, None if t[1] is None else len(t[1]), 7, "x", 3, "y", "zz", 1, 2) for t in texts]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(c.lower() if c.isascii() else c for c in text)
    return SPACES.findall(text)


def jaccard(data: list[tuple]) -> list[tuple]:
    sets = []
    for _, text in data:
        w = words(text, True)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if data[i][0] is None or data[j][0] is None or not a or not sets[j]:
                continue
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (id, _) in enumerate(data):
        if id is not None:
            low[find(i)] = min(low.get(find(i), id), id)
    return [(id, len(s), None if id is None else low[find(i)]) for i, ((id, _), s) in enumerate(zip(data, sets, strict=True))]


def without_repeats(data: list[tuple], size: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    for id, text in data:
        w = words(text)
        for i in range(len(w) - size + 1) if id is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, id), id)
    out = []
    for id, text in data:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1) if id is not None else ():
            if first[tuple(w[i : i + size])] < id:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_words(text: str | None) -> int:
    w = words(text)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)})


def checksum(id) -> int:
    return zlib.crc32(b"" if id is None else str(id).encode())


def ordered(values) -> list:
    return sorted(values, key=lambda r: tuple((v is None, str(v)) for v in r))
