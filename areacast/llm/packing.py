"""Best-fit packing of tokenized documents, planned on the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from areacast.llm.text import rows, tidy
from areacast.sources.shared import settle

#: Pieces of one length that are numbered in one task.
RANKED = 50_000
_ENCODERS: dict[str, tiktoken.Encoding] = {}
_WHOLE: dict[str, Tokenizer] = {}

#: Fixed value: the way byte-level vocabularies split a text before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file's encoder; its ids are the ranks of its merges."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): id
            for token, id in spec["model"]["vocab"].items()
            if token not in special
        }
        _ENCODERS[path] = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _ENCODERS[path]


def text_ids(path: str, text: str) -> list[int]:
    """Ids of a text; special strings in it are their tokens."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        # Its splitter gives up on some 700,000 blanks or line ends in a row.
        if path not in _WHOLE:
            _WHOLE[path] = Tokenizer.from_file(path)
        return _WHOLE[path].encode(text, add_special_tokens=False).ids


def token_ids(path: str, text: str | None, end: int) -> np.ndarray:
    ids = text_ids(path, text) if text else []
    return np.array([*ids, end], np.uint32)


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]):
        out = []
        for id, text in rows(batches):
            ids = token_ids(path, text, end)
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append((id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if len(out) >= 4096:
                yield _piece_rows(out)
                out = []
        if out:
            yield _piece_rows(out)

    return run


def _piece_rows(out: list[tuple]) -> pa.RecordBatch:
    id, piece, start, length, crc = zip(*out, strict=True)
    return pa.record_batch(
        {
            "id": pa.array(id, pa.int64()),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
    )


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots for ``counts`` of pieces by length, longest first, each in the tightest room.

    Sequences with equal room are held as runs of numbers, so the work depends on the
    lengths, not on the number of pieces.  Row: pieces of ``length`` ranked from
    ``rank`` on go to sequences from ``sequence`` on, at ``offset``.
    """
    room: dict[int, list[list[int]]] = {}
    plan: list[tuple[int, int, int, int]] = []
    opened = 0

    def fill(length: int, rank: int, left: int, first: int, width: int, free: int) -> int:
        """Puts pieces into ``width`` sequences as often as they fit; returns the rank."""
        while left > 0 and free >= length and width > 0:
            used = min(width, left)
            plan.append((length, rank, first, capacity - free))
            if used < width:
                room.setdefault(free, []).append([first + used, width - used])
            rank, left, width, free = rank + used, left - used, used, free - length
        if width > 0 and free > 0:
            room.setdefault(free, []).append([first, width])
        return rank

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        total, rank = counts[length], 0
        for free in sorted(r for r in room if r >= length):
            while room.get(free) and rank < total:
                first, width = room[free].pop()
                if width > total - rank:
                    room[free].append([first + total - rank, width - total + rank])
                    width = total - rank
                rank = fill(length, rank, total - rank, first, width, free)
            if rank >= total:
                break
        if rank < total:
            width = -(-(total - rank) // (capacity // length))
            rank = fill(length, rank, total - rank, opened, width, capacity)
            opened += width
    columns = np.array(plan, np.int64).reshape(-1, 4)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return dict(zip(("length", "rank", "sequence", "offset"), columns.T, strict=True))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end: int = 2,
) -> DataFrame:
    """A row for each piece of ``docs``: where it starts and where it is packed.

    A document is its token ids and ``end``; longer ones than ``capacity`` are cut
    into full pieces after a first one that may be shorter.  Columns: ``id, piece,
    start, length, ids_crc32, sequence_id, offset``.  A missing or empty text is the
    end alone; rows without id and repeated rows are packed like others; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = settle(
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
            tidy(_pieces(tokenizer, end, capacity)),
            "id long, piece int, start long, length long, ids_crc32 long",
        ),
        "pieces",
    )
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # <= capacity rows
    plan = spark.sparkContext.broadcast(
        best_fit_plan({r["length"]: r["n"] for r in counts}, capacity)
    )
    buckets = F.broadcast(
        spark.createDataFrame(
            [(r["length"], -(-r["n"] // RANKED)) for r in counts], "length long, buckets long"
        )
    )
    spread = pieces.join(buckets, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("id", "piece"), F.col("buckets"))
    )
    up_to = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = (
        spread.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
        .drop("n")
    )
    order = W.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = (
        spread.withColumn("rank", F.row_number().over(order) - 1)
        .join(before, ["length", "bucket"])
        .select(
            "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")
        )
    )
    return ranked.mapInArrow(
        _slots(plan),
        "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    ).withColumnRenamed("id", id)


def _slots(plan):
    def run(batches: Iterator[pa.RecordBatch]):
        p = plan.value
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            low = np.searchsorted(p["length"], length, "left")
            high = np.searchsorted(p["length"], length, "right")
            at = np.empty(len(length), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                a, z = low[mine[0]], high[mine[0]]
                at[mine] = a + np.searchsorted(p["rank"][a:z], rank[mine], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:5],
                    pa.array(p["sequence"][at] + rank - p["rank"][at], pa.int64()),
                    pa.array(p["offset"][at], pa.int64()),
                ],
                names=[*b.schema.names[:5], "sequence_id", "offset"],
            )

    return run
