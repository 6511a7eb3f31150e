"""Alignment of two tokenizers: which of their tokens cover the same bytes, and how often.

Both cut a text with a blank before it.  No token of either spans a blank that follows
another character, so a text falls into chunks, each a blank and what follows, whose
tokens and alignment are worked out once a task.

Pairs of tokens are counted by external spills.  A run of documents leaves its pairs,
sorted by the side of B and radix-partitioned on it, as zstd bodies in a written table.
A heap merges the runs of a partition, side by side, which gives the counts; in a second
pass the totals of a partition, with the highest of each side marked, meet its runs again
and what each run's documents gain streams back to the run.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from areacast.llm.packing import encoder
from areacast.llm.text import rows
from areacast.sources.shared import settle

#: Partitions of the side of B.
RADIX = 256
#: Characters and documents of a run.
RUN_CHARS, RUN_DOCS = 8_000_000, 60_000
#: Pair-document records that one task merges; a partition of more is dealt to several.
PART = 8_000_000
#: Chunks and links of chunks that a task remembers.
REMEMBERED, REMEMBERED_LINKS = 400_000, 8_000_000
#: From this length on the first tokenizer's own library encodes a chunk.
LONG = 20_000

_CUT = regex.compile(r"(?<=\S) ")
_JOINED = regex.compile(r"\s |^ ")
_DOCS = "place int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RUNS = f"run long, {_DOCS}, bucket int, records long, pairs binary, docs binary"


class _Numbers(dict):
    """A number for each chunk; new chunks wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class Aligner:
    """Tokens, groups and links of chunks under a byte-level vocabulary and a piece model."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.path_a, self.slow = encoder(path_a), path_a, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self._byte_token(i) for i in range(self.a.n_vocab)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.wide = -(-self.size_b // RADIX)
        self.long_a = np.array(list(map(len, self.bytes_a)))
        self.long_b = np.array(list(map(len, self.bytes_b)))
        pieces = (self.b.id_to_piece(i) for i in range(self.size_b))
        #: Whether a blank after another character always starts a piece.
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = self.b.piece_to_id("▁")
        digits = np.zeros((max(self.size_a, self.size_b), 8), np.uint8)
        left = np.arange(len(digits))
        for at in range(6, -1, -1):
            digits[:, at] = np.where((left > 0) | (at == 6), left % 10 + 48, 0)
            left //= 10
        self.digits = digits
        self.forget()

    def _byte_token(self, id: int) -> bytes:
        try:
            return self.a.decode_single_token_bytes(id)
        except KeyError:
            return b""

    def _piece(self, id: int) -> bytes:
        piece = self.b.id_to_piece(id)
        if self.b.is_byte(id):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.numbers = _Numbers()
        #: Per chunk: tokens of A and B, groups, links, and whether bytes are lost.
        self.sizes = np.zeros((0, 5), np.int64)
        self.groups: list[bytes] = []
        self.links = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    @property
    def full(self) -> bool:
        return len(self.numbers) > REMEMBERED or len(self.links) > REMEMBERED_LINKS

    def chunked(self, text: str) -> list[int]:
        """Numbers of the text's chunks; each chunk stands for itself after a blank."""
        if not self.separable:
            parts = [text]
        elif _JOINED.search(text):
            parts = _CUT.split(text)
        else:
            parts = text.split(" ")
        return list(map(self.numbers.__getitem__, parts))

    def ids_a(self, chunk: str) -> list[int]:
        if len(chunk) < LONG:
            return self.a.encode_ordinary(" " + chunk)
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path_a)
            self.slow.encode_special_tokens = True
        return self.slow.encode(" " + chunk, add_special_tokens=False).ids

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        # The model adds no blank to an empty text.
        return [ids if c else [self.blank] for c, ids in zip(chunks, self.b.encode(chunks, num_threads=1), strict=True)]

    def learn(self) -> None:
        """Aligns the chunks that wait."""
        chunks, self.numbers.new = self.numbers.new, []
        if not chunks:
            return
        a, b = list(map(self.ids_a, chunks)), self.ids_b(chunks)
        lost = np.zeros(len(chunks), bool)
        for i, (chunk, x, y) in enumerate(zip(chunks, a, b, strict=True)):
            whole = b" " + chunk.encode()
            if b"".join(map(self.bytes_a.__getitem__, x)) != whole or b"".join(map(self.bytes_b.__getitem__, y)) != whole:
                lost[i], a[i], b[i] = True, [], []
        sizes, links, groups = self._aligned(a, b, len(chunks))
        self.sizes = np.concatenate([self.sizes, np.column_stack([sizes, lost])])
        self.links = np.concatenate([self.links, links])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes[:, 3]))
        self.groups += groups

    def _aligned(self, a: list[list[int]], b: list[list[int]], chunks: int):
        """Sizes, links and group texts of chunks laid end to end."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, chunks) for x in (a, b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b))
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        chunk_a, chunk_b = np.repeat(np.arange(chunks), n_a), np.repeat(np.arange(chunks), n_b)
        cuts = np.union1d(end_a, end_b)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        n_links = np.bincount(chunk_a[at_a], minlength=chunks)
        n_groups = np.bincount(chunk_a[np.searchsorted(end_a, both)], minlength=chunks)
        links = self.side(b[at_b]) * self.size_a + a[at_a]

        # Tokens in the order of the text of groups: a group's A ids, then its B ids.
        until_a, until_b = np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right")
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        place_a = np.arange(len(a)) + np.append(0, until_b)[group_a]
        place_b = np.arange(len(b)) + np.append(until_a, 0)[group_b]
        shown = np.empty((len(a) + len(b), 8), np.uint8)
        shown[place_a], shown[place_b] = self.digits[a], self.digits[b]
        shown[place_a, 7] = np.where(np.isin(end_a, both, assume_unique=True), ord("|"), ord(","))
        shown[place_b, 7] = np.where(np.isin(end_b, both, assume_unique=True), ord(";"), ord(","))
        owner = np.empty(len(shown), np.int64)
        owner[place_a], owner[place_b] = chunk_a, chunk_b
        used = shown != 0
        text = shown[used].tobytes()
        stops = np.cumsum(np.bincount(owner, used.sum(axis=1), chunks)).astype(np.int64).tolist()
        groups = [text[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        return np.column_stack([n_a, n_b, n_groups, n_links]), links, groups

    def side(self, b: np.ndarray) -> np.ndarray:
        """B ids in the order of their partitions, a partition holding ``wide`` of them."""
        return b % RADIX * self.wide + b // RADIX


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as one zstd body."""
    head = np.array([len(c) for c in columns], np.int64).tobytes()
    return zstandard.compress(head + b"".join(c.tobytes() for c in columns), 3)


def _unpacked(body: bytes, *types) -> list[np.ndarray]:
    data = zstandard.decompress(body)
    sizes, at, out = np.frombuffer(data, np.int64, len(types)), 8 * len(types), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(data, kind, int(size), at))
        at += out[-1].nbytes
    return out


def _spilled(path_a: str, path_b: str):
    """Rows of documents, and the runs of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]):
        c = aligner(path_a, path_b)
        c.forget()
        number = TaskContext.get().partitionId() << 24
        held, chars = [], 0
        for id, text in rows(batches):
            held.append((id, np.array(c.chunked(text) if text else [], np.int64)))
            chars += len(text or "")
            if chars >= RUN_CHARS or len(held) >= RUN_DOCS:
                yield from _run(c, number, held)
                number, held, chars = number + 1, [], 0
        if held:
            yield from _run(c, number, held)

    return run


def _run(c: Aligner, number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    c.learn()
    table, found = [], []
    for place, (id, chunks) in enumerate(held):
        sizes = c.sizes[chunks].sum(axis=0)
        if not len(chunks) or sizes[4]:
            table.append((place, id, 0, 0, 0, 0, ""))
            continue
        groups = b"".join(map(c.groups.__getitem__, chunks.tolist()))[:-1]
        table.append((place, id, *sizes[:4].tolist(), hashlib.sha256(groups).hexdigest()))
        kinds, times = np.unique(chunks, return_counts=True)
        found.append((np.full(len(kinds), place), kinds, times))
    yield _run_rows(number, table, [])
    if found:
        yield _run_rows(number, [], _pairs(c, *map(np.concatenate, zip(*found, strict=True))))
    if c.full:
        c.forget()


def _pairs(c: Aligner, place: np.ndarray, chunk: np.ndarray, times: np.ndarray) -> list[tuple]:
    """Bodies of a run by partition: pairs in order, then each pair's documents."""
    size = c.ends[chunk + 1] - c.ends[chunk]
    skip = np.cumsum(size) - size
    link = np.arange(int(size.sum())) + np.repeat(c.ends[chunk] - skip, size)
    key = c.links[link] << 16 | np.repeat(place, size)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.add.reduceat(np.repeat(times, size)[order], first)
    pair, place = key[first] >> 16, key[first] & 0xFFFF
    reach = c.wide * c.size_a
    cuts = np.searchsorted(pair, np.arange(RADIX + 1) * reach)
    out = []
    for bucket in range(RADIX):
        i, j = cuts[bucket], cuts[bucket + 1]
        if i == j:
            continue
        own = pair[i:j] - bucket * reach
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        steps = np.diff(own[starts], prepend=0).astype(np.uint32)
        total = np.add.reduceat(times[i:j], starts).astype(np.uint64)
        held = np.diff(np.append(starts, j - i)).astype(np.uint32)
        out.append(
            (bucket, int(j - i), _packed(steps, total),
             _packed(held, place[i:j].astype(np.uint16), times[i:j].astype(np.uint32)))
        )
    return out


def _run_rows(number: int, table: list[tuple], bodies: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = ("place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
             "bucket", "records", "pairs", "docs")
    made = [(*r, None, None, None, None) for r in table] + [(*[None] * 7, *r) for r in bodies]
    columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.int64()), *columns], names=("run", *names))


def _merged(size_a: int):
    """Counts of pairs over the runs of a task, by a heap of the runs' next sides."""

    def groups(batches):
        task, bodies = None, []
        for t, bucket, body in rows(batches):
            if t != task and bodies:
                yield bodies
                bodies = []
            task = t
            bodies.append((bucket, body))
        if bodies:
            yield bodies

    def run(batches: Iterator[pa.RecordBatch]):
        for bodies in groups(batches):
            bucket, heap, out, held = bodies[0][0], [], [], 0
            for n, (_, body) in enumerate(bodies):
                steps, total = _unpacked(body, np.uint32, np.uint64)
                pair = np.cumsum(steps, dtype=np.int64)
                side = pair // size_a
                cuts = [*np.flatnonzero(np.append(True, side[1:] != side[:-1])).tolist(), len(pair)]
                heap.append((int(side[0]), n, 0, cuts, pair, total))
            heapq.heapify(heap)
            while heap:
                side, parts = heap[0][0], []
                while heap and heap[0][0] == side:
                    _, n, k, cuts, pair, total = heap[0]
                    parts.append((pair[cuts[k] : cuts[k + 1]], total[cuts[k] : cuts[k + 1]]))
                    if k + 2 < len(cuts):
                        heapq.heapreplace(heap, (int(pair[cuts[k + 1]] // size_a), n, k + 1, cuts, pair, total))
                    else:
                        heapq.heappop(heap)
                pair, total = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                out.append((pair[first], np.add.reduceat(total[order], first)))
                held += len(first)
                if held >= 500_000:
                    yield _count_rows(bucket, out, size_a)
                    out, held = [], 0
            if out:
                yield _count_rows(bucket, out, size_a)

    return run


def _count_rows(bucket: int, out: list[tuple], size_a: int) -> pa.RecordBatch:
    pair, total = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.record_batch(
        {
            "bucket": np.full(len(pair), bucket, np.int32),
            "side": (pair // size_a).astype(np.int32),
            "a": (pair % size_a).astype(np.int32),
            "n": total.astype(np.int64),
        }
    )


def _totals(size_a: int):
    """One body a partition: its pairs, their counts, and which are their side's highest."""

    def run(batches: Iterator[pa.RecordBatch]):
        bucket, parts = None, []

        def body():
            pair, n, best = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()),
                 pa.array([_packed(np.diff(pair, prepend=0).astype(np.uint32), n.astype(np.uint64), best)], pa.binary())],
                names=("bucket", "totals"),
            )

        for batch in batches:
            own = batch.column("bucket").to_numpy()
            pair = batch.column("side").to_numpy().astype(np.int64) * size_a + batch.column("a").to_numpy()
            n = batch.column("n").to_numpy()
            best = batch.column("best").to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist(), len(own)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if parts and own[i] != bucket:
                    yield body()
                    parts = []
                bucket = int(own[i])
                parts.append((pair[i:j], n[i:j], best[i:j]))
        if parts:
            yield body()

    return run


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the documents of each run gain from a partition; its totals come first."""
    known = count = best = None
    for number, pairs, docs, totals in rows(batches):
        if totals is not None:
            steps, count, best = _unpacked(totals, np.uint32, np.uint64, np.bool_)
            known = np.cumsum(steps, dtype=np.int64)
            continue
        steps, _ = _unpacked(pairs, np.uint32, np.uint64)
        at = np.searchsorted(known, np.cumsum(steps, dtype=np.int64))
        held, place, times = _unpacked(docs, np.uint32, np.uint16, np.uint32)
        at = np.repeat(at, held)
        order = np.argsort(place, kind="stable")
        place, at, times = place[order], at[order], times[order].astype(np.uint64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        won = np.add.reduceat(times * best[at], first)
        total = np.add.reduceat(times * count[at], first)
        body = _packed(place[first], won.astype(np.uint32), total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([body], pa.binary())], names=("run", "gain")
        )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a run's gains, a row for each of its documents that has any."""
    now, best, total = None, None, None

    def made():
        place = np.flatnonzero(total)
        return pa.record_batch(
            {
                "run": np.full(len(place), now, np.int64),
                "place": place.astype(np.int32),
                "n_best": best[place].astype(np.int64),
                "count_sum": total[place].astype(np.int64),
            }
        )

    for number, body in rows(batches):
        if number != now:
            if now is not None:
                yield made()
            now, best, total = number, np.zeros(RUN_DOCS, np.uint64), np.zeros(RUN_DOCS, np.uint64)
        place, won, added = _unpacked(body, np.uint16, np.uint32, np.uint64)
        best[place] += won
        total[place] += added
    if now is not None:
        yield made()


def align_tokenizers(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the counts of token pairs.

    ``tokenizer_a`` is a byte-level vocabulary, ``tokenizer_b`` a piece model that puts a
    blank before a text.  Documents: ``id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.  Pairs: ``b, a, n, best`` for each pair of ids linked
    anywhere; ``best`` marks the highest count of each B id, ties included.

    Texts that are missing or empty, or that either tokenizer does not give back byte
    for byte, have no tokens: zeros and an empty digest.  Ids may be missing or
    repeated, each row is a document of its own; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    c = aligner(tokenizer_a, tokenizer_b)
    size_a, wide = c.size_a, c.wide
    runs = settle(
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
            _spilled(tokenizer_a, tokenizer_b), _RUNS
        ),
        "runs",
    )
    spilled = runs.where("bucket is not null")
    sizes = spilled.groupBy("bucket").agg(F.sum("records").alias("n")).collect()  # <= RADIX rows
    parts = {r["bucket"]: -(-r["n"] // PART) for r in sizes}
    tasks = max(spark.sparkContext.defaultParallelism, sum(r["n"] for r in sizes) // PART + 1)
    # A partition's runs are dealt to as many tasks as its records need.
    share = F.broadcast(
        spark.createDataFrame(sorted(parts.items()), "bucket int, parts int")
    )
    dealt = spilled.join(share, "bucket").withColumn(
        "task", F.col("bucket") * 1_000_000 + F.pmod(F.xxhash64("run"), F.col("parts")).cast("int")
    )
    counted = (
        dealt.select("task", "bucket", "pairs")
        .repartition(tasks, "task")
        .sortWithinPartitions("task")
        .mapInArrow(_merged(size_a), "bucket int, side int, a int, n long")
        .groupBy("bucket", "side", "a")
        .agg(F.sum("n").alias("n"))
    )
    # A side has at most as many pairs as A has ids.
    highest = F.max("n").over(W.partitionBy("bucket", "side"))
    pairs = settle(counted.withColumn("best", F.col("n") == highest), "pairs")
    totals = (
        pairs.repartition("bucket")
        .sortWithinPartitions("bucket", "side", "a")
        .mapInArrow(_totals(size_a), "bucket int, totals binary")
        .join(share, "bucket")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select((F.col("bucket") * 1_000_000 + F.col("part")).alias("task"), "totals")
    )
    none = F.lit(None)
    gains = (
        dealt.select("task", "run", "pairs", "docs", none.cast("binary").alias("totals"))
        .unionByName(
            totals.select(
                "task", none.cast("long").alias("run"), none.cast("binary").alias("pairs"),
                none.cast("binary").alias("docs"), "totals",
            )
        )
        .repartition(tasks, "task")
        .sortWithinPartitions("task", F.col("run").asc_nulls_first())
        .select("run", "pairs", "docs", "totals")
        .mapInArrow(_gains, "run long, gain binary")
        .repartition("run")
        .sortWithinPartitions("run")
        .mapInArrow(_gathered, "run long, place int, n_best long, count_sum long")
    )
    out = (
        runs.where("place is not null")
        .join(gains, ["run", "place"], "left")
        .select(
            F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
            "groups_sha256",
        )
    )
    b = F.col("side") * RADIX + F.col("bucket")
    return out, pairs.select(b.cast("int").alias("b"), "a", "n", "best")
