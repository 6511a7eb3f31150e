"""Words of a text and 64-bit hashes of words and word windows, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs without these characters.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_BREAK = r"[\x20\x09-\x0D]+"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words; ``lower`` folds A-Z alone.  None has none."""
    if not text:
        return []
    data = text.encode("utf-8")
    return (data.lower() if lower else data).split()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """A hash of each word, by a table of (place, byte); long words by xxhash."""
    blocks = [_block_hashes(parts[at : at + _WORDS]) for at in range(0, len(parts), _WORDS)]
    return np.concatenate(blocks) if blocks else np.empty(0, np.uint64)


def _block_hashes(parts: list[bytes]) -> np.ndarray:
    body, long = b" ".join(parts) + b" ", []
    if len(body) > (_LONG + 1) * len(parts):
        # Some are long: they are left out, so that a block stays small.
        long = [i for i, w in enumerate(parts) if len(w) > _LONG]
        short = [b"" if len(w) > _LONG else w for w in parts]
        body = b" ".join(short) + b" "
    data = np.frombuffer(body, np.uint8)
    ends = np.flatnonzero(data == 0x20)
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends + 1 - starts
    if not long and sizes.max() > _LONG + 1:
        long = np.flatnonzero(sizes > _LONG + 1).tolist()
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    if long:
        np.minimum(place, _LONG, out=place)
    out = mix(np.add.reduceat(_TABLE[place * 256 + data], starts))
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(parts[i])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; empty if there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, size, np.uint64)
    for j in range(size):
        h = h * _STEP + hashes[j : j + count]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a task that takes much memory, and gives it back at its end.

    Spark keeps Python workers for later tasks, also idle ones; what a worker has freed
    stays with its allocators, and would count for each of them.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return tidied


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


#: Words hashed together, and the longest that the table hashes.
_WORDS, _LONG = 1 << 15, 64
#: A number for each byte at each place of a word; the blank behind a word counts as well.
_TABLE = mix(np.arange(1, (_LONG + 1) * 256 + 1, dtype=np.uint64) * _STEP)


def word_count(text: Column) -> Column:
    """Number of words, without Python; a missing text has none."""
    return F.coalesce(F.size(word_array(text)).cast("long"), F.lit(0).cast("long"))


def word_array(text: Column) -> Column:
    """Words in order, without Python; a missing text has an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one if a table has a column of that name in any case."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name
