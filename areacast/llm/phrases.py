"""Collocations by language: phrases whose words stand together more than their parts do.

A task gathers its documents' words by language into shards.  Words are counted over all
shards; those too rare for any candidate end a piece like punctuation does.  Each shard
is then indexed both ways over word numbers (``phraseindex``) and its phrases enumerated
by extending intervals: words to the right into pairs, which are summed over the shards,
and the pairs that are frequent anywhere to the left into triples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areacast.llm.phraseindex import PhraseIndex
from areacast.llm.text import mix
from areacast.sources.shared import settle

#: Words and different words of a shard.
SHARD_WORDS, SHARD_KINDS = 4_000_000, 1_000_000
#: Bits of the table of frequent pairs that shards see, and of a page of it.  Plan only:
#: pairs that share a bit are extended in vain.
PAIR_BITS, PAGE_BITS = 26, 16
#: Bytes of text that are split at once.
BLOCK = 1 << 20
#: Bits of a word's number in its shard, and of a shard's number in its task.
KIND_BITS, SHARD_BITS = 30, 12

_BREAKS = bytes(
    10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


class _Shard(dict):
    """Words of one language in order; number 0 ends a piece."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})
        self.text: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.waiting = self.size = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 1
        return number

    def add(self, text: str) -> None:
        data = text.encode("utf-8").translate(_BREAKS)
        self.text.append(data)
        self.waiting += len(data)
        if self.waiting >= BLOCK:
            self.split()

    def split(self) -> None:
        words = b"\n".join([*self.text, b""]).replace(b"\n", b" \n ").split(b" ")
        self.text, self.waiting = [], 0
        part = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        part = part[part >= 0]
        # Runs of ends are one.
        self.parts.append(part[np.append(part[:1] > 0, (part[1:] > 0) | (part[:-1] > 0))])
        self.size += len(self.parts[-1])


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each shard with their counts, and its text as numbers."""
    shards: dict[str, _Shard] = {}
    number = TaskContext.get().partitionId() << SHARD_BITS
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if text:
                    shards.setdefault(lang, _Shard()).add(text)
            full = sum(s.size + s.waiting // 6 for s in shards.values()) >= SHARD_WORDS
            if full or sum(map(len, shards.values())) >= SHARD_KINDS:
                for lang, shard in shards.items():
                    yield from _shard_rows(number, lang, shard)
                    number += 1
                shards = {}
    for lang, shard in shards.items():
        yield from _shard_rows(number, lang, shard)
        number += 1


def _shard_rows(number: int, lang: str, shard: _Shard) -> Iterator[pa.RecordBatch]:
    shard.split()
    text = np.concatenate(shard.parts)
    kinds = len(shard) - 2
    n = np.bincount(text, minlength=kinds + 1)[1:]
    words = [w for w, i in shard.items() if i > 0]

    def batch(size, **columns):
        types = {"shard": pa.int64(), "lang": pa.string(), "kind": pa.int64(), "word": pa.string(),
                 "n": pa.int64(), "body": pa.binary()}
        columns |= {"shard": [number] * size, "lang": [lang] * size}
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()],
            names=list(types),
        )

    for at in range(0, kinds, 50_000):
        some = [w.decode("utf-8") for w in words[at : at + 50_000]]
        size = len(some)
        yield batch(size, kind=np.arange(at + 1, at + 1 + size), word=some, n=n[at : at + size])
    yield batch(1, body=[zstandard.compress(text.astype(np.uint32).tobytes(), 3)])


def _indexed(frequent, longest: int, emit):
    """Runs ``emit`` over each shard's index; word numbers come before the text."""

    def run(batches: Iterator[pa.RecordBatch]):
        pages = None if frequent is None else frequent.value
        kinds, names = [], []
        for batch in batches:
            body = batch.column("body")
            cuts = [*np.flatnonzero(body.is_valid().to_numpy(zero_copy_only=False)).tolist()]
            start = 0
            for at in [*cuts, batch.num_rows]:
                piece = batch.slice(start, at - start)
                kinds.append(piece.column("kind").to_numpy(zero_copy_only=False))
                names.append(piece.column("name").to_numpy(zero_copy_only=False))
                if at < batch.num_rows:
                    kind, name = (np.concatenate(x).astype(np.int64) for x in (kinds, names))
                    text = np.frombuffer(zstandard.decompress(body[at].as_py()), np.uint32)
                    kinds, names = [], []
                    if len(kind):
                        yield from emit(*_renumbered(text, kind, name, longest), pages)
                start = at + 1

    return run


def _renumbered(text: np.ndarray, kind: np.ndarray, name: np.ndarray, longest: int):
    """The index of a shard over its frequent words in the order of their names."""
    order = np.argsort(name)
    number = np.zeros(max(int(text.max(initial=0)), int(kind.max())) + 1, np.int32)
    number[kind[order]] = np.arange(1, len(kind) + 1)
    now = number[text]
    now = now[np.append(now[:1] > 0, (now[1:] > 0) | (now[:-1] > 0))]
    return PhraseIndex(now, len(kind) + 1, longest), name[order]


def _pairs(index: PhraseIndex, name: np.ndarray, pages) -> Iterator[pa.RecordBatch]:
    word, forward, backward, count = index.words()
    parent, last, _, _, n = index.right(forward, backward, count, last=True)
    first, last = name[word[parent] - 1], name[last - 1]
    yield from _phrase_rows(first=first, second=last, n=n)


def _triples(index: PhraseIndex, name: np.ndarray, pages) -> Iterator[pa.RecordBatch]:
    word, forward, backward, count = index.words()
    parent, last, forward, backward, n = index.right(forward, backward, count)
    second, third = name[word[parent] - 1], name[last - 1]
    slot = _slot(second, third)
    page = pages[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
    forward, backward, n, second, third = (x[page] for x in (forward, backward, n, second, third))
    parent, word, _, _, n = index.left(forward, backward, n, last=True)
    first, second, third = name[word - 1], second[parent], third[parent]
    slot = _slot(first, second)
    kept = pages[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
    yield from _phrase_rows(first=first[kept], second=second[kept], third=third[kept], n=n[kept])


def _phrase_rows(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns["n"]), 100_000):
        yield pa.record_batch({k: pa.array(v[at : at + 100_000], pa.int64()) for k, v in columns.items()})


def _slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bit of a pair in the table of frequent pairs."""
    h = mix(first.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    return mix(h) >> np.uint64(64 - PAIR_BITS)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = _slot(batch.column("first").to_numpy(), batch.column("second").to_numpy())
        yield pa.record_batch(
            {
                "page": (slot >> np.uint64(PAGE_BITS)).astype(np.int32),
                "bit": (slot & np.uint64((1 << PAGE_BITS) - 1)).astype(np.int32),
            }
        )


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        page, bit = batch.column("page").to_numpy(), batch.column("bit").to_numpy()
        for p in np.unique(page).tolist():
            pages.setdefault(p, np.zeros(1 << PAGE_BITS, np.uint8))[bit[page == p]] = 1
    for p, bits in pages.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
            names=("page", "bits"),
        )


def _frequent_pairs(pairs: DataFrame):
    """A bit for each frequent pair; a table of fixed size."""
    pages = (
        pairs.select("first", "second")
        .mapInArrow(_placed, "page int, bit int")
        .repartition("page")
        .mapInArrow(_paged, "page int, bits binary")
        .collect()  # at most 2^(PAIR_BITS - PAGE_BITS) rows
    )
    table = np.zeros(1 << (PAIR_BITS - 3), np.uint8)
    size = 1 << (PAGE_BITS - 3)
    for r in pages:
        table[r["page"] * size : (r["page"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(table)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 10,
    share: int = 50,
    top: int | None = 2000,
    unknown: str = "und",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases by language.

    Words are lower-cased in A-Z and counted in pieces between punctuation and line ends.
    Phrases of two or three words with at least ``least`` occurrences (``a``) score
    ``floor(1000000 a a / (l r))`` at the cut into ``l`` and ``r`` where that is least.
    A pair is dropped if a triple around it has ``share`` percent of its occurrences or
    more.  Ranks go by score and ``a`` descending, then by phrase in byte order; ``top``
    of None keeps all.  Rows without text hold no words, rows without language are of
    ``unknown``; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    shards = settle(
        docs.select(F.coalesce(F.col(lang), F.lit(unknown)).alias("lang"), F.col(text).alias("text")).mapInArrow(
            _sharded, "shard long, lang string, kind long, word string, n long, body binary"
        ),
        "shards",
    )
    same = W.partitionBy("lang", "word")  # a row for each shard that holds the word
    own = F.col("shard") * (1 << KIND_BITS) + F.col("kind")
    words = settle(
        shards.where("word is not null")
        .select("shard", "lang", "kind", "word", "n")
        .withColumn("name", own)
        .withColumns({"f": F.sum("n").over(same), "name": F.min("name").over(same)})
        .where(F.col("f") >= least)
        .select("shard", "lang", "kind", "word", "f", "name"),
        "words",
    )
    numbered = (
        words.select("shard", "kind", "name", F.lit(None).cast("binary").alias("body"))
        .unionByName(
            shards.where("body is not null").select(
                "shard", F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("name"), "body"
            )
        )
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("body").isNotNull())
        .select("kind", "name", "body")
    )
    pairs = settle(
        numbered.mapInArrow(_indexed(None, 2, _pairs), "first long, second long, n long")
        .groupBy("first", "second")
        .agg(F.sum("n").alias("a"))
        .where(F.col("a") >= least),
        "pairs",
    )
    frequent = _frequent_pairs(pairs)
    triples = settle(
        numbered.mapInArrow(_indexed(frequent, 3, _triples), "first long, second long, third long, n long")
        .groupBy("first", "second", "third")
        .agg(F.sum("n").alias("a"))
        .where(F.col("a") >= least),
        "triples",
    )
    vocabulary = words.where(F.col("name") == own).select("name", "lang", "word", "f")
    totals = shards.where("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    found = _scored_pairs(pairs, triples, vocabulary, share).unionByName(_scored_triples(pairs, triples, vocabulary))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _named(table: DataFrame, vocabulary: DataFrame, column: str, with_lang: bool = False) -> DataFrame:
    """Word and count of the word that ``column`` names."""
    columns = [
        F.col("name").alias(column), F.col("word").alias(f"{column}_word"), F.col("f").alias(f"{column}_f"),
    ]
    return table.join(vocabulary.select(*columns, *(["lang"] if with_lang else [])), column)


def _exact(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)); the products are decimals of up to 37 digits."""
    a, left, right = (F.col(c).cast("decimal(14,0)") for c in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", a * a * million, left * right).cast("long")


def _scored_pairs(pairs: DataFrame, triples: DataFrame, vocabulary: DataFrame, share: int) -> DataFrame:
    inside = F.array(
        F.struct(F.col("first").alias("x"), F.col("second").alias("y")),
        F.struct(F.col("second").alias("x"), F.col("third").alias("y")),
    )
    longer = (
        triples.select(F.explode(inside).alias("p"), F.col("a").alias("longer"))
        .groupBy(F.col("p.x").alias("first"), F.col("p.y").alias("second"))
        .agg(F.max("longer").alias("longer"))
    )
    kept = pairs.join(longer, ["first", "second"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    both = _named(_named(kept, vocabulary, "first", True), vocabulary, "second")
    return both.select(
        "lang",
        F.concat_ws(" ", "first_word", "second_word").alias("phrase"),
        "a",
        F.col("first_f").alias("l"),
        F.col("second_f").alias("r"),
        _exact("a", "first_f", "second_f").alias("score"),
    )


def _scored_triples(pairs: DataFrame, triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    front = pairs.withColumnRenamed("a", "front")
    back = pairs.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("back"))
    named = triples.join(front, ["first", "second"]).join(back, ["second", "third"])
    for column in ("first", "second", "third"):
        named = _named(named, vocabulary, column, column == "first")
    cut = named.withColumns(
        {"one": _exact("a", "first_f", "back"), "two": _exact("a", "front", "third_f")}
    )
    later = F.col("two") < F.col("one")
    return cut.select(
        "lang",
        F.concat_ws(" ", "first_word", "second_word", "third_word").alias("phrase"),
        "a",
        F.when(later, F.col("front")).otherwise(F.col("first_f")).alias("l"),
        F.when(later, F.col("third_f")).otherwise(F.col("back")).alias("r"),
        F.least("one", "two").alias("score"),
    )
