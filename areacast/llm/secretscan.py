"""Secrets in texts: plain patterns, and strings that a primed compressor cannot shorten.

Besides the patterns, every string-like run of characters close behind a sensitive word
is a candidate.  Its novelty is what it adds to the compressed size of the text around
it, under a zstandard dictionary of the words that stand around candidates anywhere in
the corpus: names and paths cost little, a random string costs about its own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.llm.text import rows
from areacast.sources.shared import settle

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns and the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|key|bearer|authorization|credential|signature",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SENSITIVE_WORDS = (
    b"pass", b"pwd", b"secret", b"token", b"key", b"bearer", b"authorization", b"credential", b"signature",
)
#: Characters between a sensitive word and a candidate, and of text on either side.
GAP, AROUND = 32, 64
LEAST = 12
RUN = re.compile(r"[A-Za-z0-9+/_.=~-]+")
_CLASSES = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=~-]")]
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}")
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: Words that any dictionary starts with.
COMMON = (
    "class const default define false final float from function global import include integer "
    "interface lambda module namespace null object package private protected public return self "
    "static string struct switch template this true type undefined value version void while "
    "authorization basic bearer config credential default header host http https localhost "
    "password path port private public request response secret server session signature "
    "token url user username example com org www"
)
#: Words of the dictionary.
DICTIONARY = 4096
#: Marginal bytes for each byte from which a string is novel.  Names and paths cost 0.4 to
#: 0.85, so plain runs must cost more; values that mix small and capital letters with
#: digits, or hold hexadecimal digits alone, are rarely names, but share a coded alphabet.
NOVEL, NOVEL_MIXED = 0.9, 0.72
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")

_BASE = "id long, n_assign long, n_access long, n_hex long"
_SPAN = "array<struct<kind: string, start: long, end: long>>"
_CANDIDATE = "array<struct<start: long, end: long, before: string, body: string, after: string>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by start and then in the order of ``KINDS``."""
    data = text.encode("utf-8")
    lower = data.lower()
    found = []
    # What cannot match is left out by plain searches before a pattern runs.
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in data.translate(_HEX_BYTES):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def string_like(body: str) -> bool:
    """Whether a run looks like a value: of two kinds of characters, and not a mere word."""
    kinds = [bool(c.search(body)) for c in _CLASSES]
    word = body.isalpha() and (body[1:].islower() or body.isupper())
    return sum(kinds) >= 2 and not word and (kinds[0] or kinds[1])


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """String-like runs behind sensitive words, apart from the spans that are taken."""
    lower = text.encode("utf-8").lower()
    if not any(w in lower for w in _SENSITIVE_WORDS):
        return []
    found: dict[int, int] = {}
    at = 0
    for word in SENSITIVE.finditer(text):
        at, last = max(at, word.end()), word.end() + GAP
        while at <= last and (run := RUN.search(text, at, last + 1)):
            start, stop = run.start(), RUN.match(text, run.start()).end()
            at = stop
            while start < stop and not text[start].isalnum():
                start += 1
            while stop > start and text[stop - 1] in ".-_~/":
                stop -= 1
            if stop - start >= LEAST and string_like(text[start:stop]):
                found[start] = stop
    spans = [(a, z) for _, a, z in taken]
    out, k = [], 0
    for start, stop in sorted(found.items()):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        # The first span that ends behind the start lies behind the run, and so do the rest.
        if k == len(spans) or spans[k][0] >= stop:
            out.append((start, stop))
    return out


class Novelty:
    """Marginal compressed size under a dictionary of known words."""

    def __init__(self, words: list[str]):
        # What stands last in a dictionary is the cheapest to refer to.
        primed = " ".join([*reversed(words), COMMON]).encode("utf-8")
        prime = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prime.precompute_compress(level=19)
        self.compressor = zstandard.ZstdCompressor(dict_data=prime, write_checksum=False)

    def size(self, text: str) -> int:
        # Known text in front: a block so short that it stays raw would hide what is saved.
        return len(self.compressor.compress((COMMON[:AROUND] + text).encode("utf-8")))

    def marginal(self, before: str, body: str, after: str) -> int:
        return self.size(before + body + after) - self.size(before + after)

    def reports(
        self, before: str, body: str, after: str, least: float = NOVEL, least_mixed: float = NOVEL_MIXED
    ) -> bool:
        mixed = _HEX_ONLY.fullmatch(body) or all(c.search(body) for c in _CLASSES[:3])
        return self.marginal(before, body, after) >= (least_mixed if mixed else least) * len(body)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for id, text in rows(batches):
        text = text or ""
        base = base_spans(text)
        open_ = [
            {"start": a, "end": z, "before": text[max(0, a - AROUND) : a], "body": text[a:z], "after": text[z : z + AROUND]}
            for a, z in candidates(text, base)
        ]
        counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
        out.append((id, *counts, [{"kind": k, "start": a, "end": z} for k, a, z in base], open_))
        if len(out) >= 2048:
            yield _scan_rows(out)
            out = []
    if out:
        yield _scan_rows(out)


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CANDIDATE_TYPE = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])
)


def _scan_rows(out: list[tuple]) -> pa.RecordBatch:
    types = (*[pa.int64()] * 4, _SPAN_TYPE, _CANDIDATE_TYPE)
    names = ("id", "n_assign", "n_access", "n_hex", "base", "open")
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words around candidates, without what is part of a candidate or of a value."""
    counts: dict[str, int] = {}

    def made():
        return pa.record_batch({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})

    for (open_,) in rows(batches):
        for c in open_:
            for side in (c["before"], c["after"]):
                for name in _NAME.findall(RUN.sub(_shadowed, side)):
                    counts[name] = counts.get(name, 0) + 1
        if len(counts) >= 200_000:
            yield made()
            counts = {}
    if counts:
        yield made()


def _shadowed(run: re.Match) -> str:
    return " " if len(run[0]) >= LEAST and string_like(run[0]) else run[0]


def _judged(words, least: float, least_mixed: float):
    def run(batches: Iterator[pa.RecordBatch]):
        novelty = Novelty(words.value)
        for batch in batches:
            base, open_ = (batch.column(k).to_pylist() for k in ("base", "open"))
            spans = []
            for one, many in zip(base, open_, strict=True):
                new = [
                    {"kind": "novel", "start": c["start"], "end": c["end"]}
                    for c in many
                    if novelty.reports(c["before"], c["body"], c["after"], least, least_mixed)
                ]
                spans.append(sorted(one + new, key=lambda s: (s["start"], KINDS.index(s["kind"]))) if new else one)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(spans, _SPAN_TYPE)], names=[*batch.schema.names[:5], "spans"]
            )

    return run


def scan_secrets(
    docs: DataFrame, id: str = "doc_id", text: str = "text", dictionary: int = DICTIONARY,
    least: float = NOVEL, least_mixed: float = NOVEL_MIXED,
) -> DataFrame:
    """``id, n_assign, n_access, n_hex, base, spans`` for every row of ``docs``.

    ``base`` and ``spans`` are arrays of (kind, start, end) by start and then in the order
    of ``KINDS``, in code points, the end exclusive; ``spans`` holds those of ``base`` and
    the novel strings.  ``dictionary`` is the number of words that prime the compressor,
    the most frequent ones around all candidates of ``docs``; ``least`` the marginal bytes
    for each byte of a candidate from which it is reported, ``least_mixed`` the same for
    values of small and capital letters and digits, or of hexadecimal digits alone.  Missing and empty texts have
    no spans; ids may be missing or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    scanned = settle(
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
            _scanned, f"{_BASE}, base {_SPAN}, open {_CANDIDATE}"
        ),
        "scanned",
    )
    names = (
        scanned.select("open")
        .where(F.size("open") > 0)
        .mapInArrow(_names, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(dictionary)
        .collect()
    )
    words = spark.sparkContext.broadcast([r["word"] for r in names])
    return scanned.mapInArrow(_judged(words, least, least_mixed), f"{_BASE}, base {_SPAN}, spans {_SPAN}").withColumnRenamed("id", id)


def span_text(spans: str):
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
