"""Substring dedup: passages that stand in an earlier document are removed.

A window of consecutive words is keyed by the smallest hash among its short n-grams
(its minimizer), so equal windows have equal keys.  Of documents with equal words only
the first is looked at.  Keys held by several of these are found first.  Runs of windows with such a key then go, as short segments of words, to
the cell of the key; a task indexes some of its cells at a time (``fmindex``) and streams
their segments through the index: the matching statistics of each window tell whether it stands elsewhere, and the
range of its suffixes which document is the first to hold it.  What one task already
knows is not sent: of equal segments of a task, that of the smallest id alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.llm.fmindex import SegmentIndex
from areacast.llm.text import rows, signed, tidy, window_hashes, word_hashes, words
from areacast.sources.shared import settle

GRAM = 7
#: Documents from which a key's windows go to cells by their own hash.  Plan only.
HOT = 4096
_HOT_BITS = 20
#: Segments of one shard, and the cells that it has on average.  A task gets whole cells, as
#: Spark hashes their numbers: so many that no task gets several times its share.
SHARD = 60_000
_CELLS = 64
#: Segments from which the cells of a task so far are indexed, before the next ones.
_INDEXED = 30_000
#: Words of texts whose keys are found together.
_TOGETHER = 100_000
#: Bytes of a word's hash that are indexed.
SYMBOL = 6


def minimizer_runs(
    hashes: np.ndarray, window: int, sizes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last window of each run of windows with one minimizer.

    ``sizes`` are the words of each text where several stand one after the other; no
    window then reaches into the next text.
    """
    grams = window_hashes(hashes, GRAM)
    count = len(hashes) - window + 1
    if count <= 0:
        empty = np.empty(0, np.int64)
        return grams[:0], empty, empty
    # The smallest of so many grams from each place on, and its place; the first of equal ones.
    best, place, seen = grams, np.arange(len(grams)), 1
    while seen < window - GRAM + 1:
        step = min(seen, window - GRAM + 1 - seen)
        lower = best[step:] < best[:-step]
        best = np.where(lower, best[step:], best[:-step])
        place = np.where(lower, place[step:], place[:-step])
        seen += step
    at = np.arange(count)
    if sizes is not None:
        at = np.flatnonzero(at + window <= np.repeat(np.cumsum(sizes), sizes)[:count])
        if not len(at):
            return grams[:0], at, at
        best, place = best[at], place[at]
    first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
    return best[first], at[first], at[np.append(first[1:], len(at)) - 1]


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 13
) -> DataFrame:
    """``id, text_hash, n_words, n_removed, kept_sha256, kept_text`` for every row.

    A word is removed if a run of ``window`` words around it also starts in a row with
    a smaller id, judged on the input.  ``kept_sha256`` is of the kept words joined by
    one space; ``kept_text`` holds them where any was removed, and is null elsewhere;
    ``text_hash`` (xxhash64 of the input) tells rows that share an id apart.
    A missing or empty text has no words; a row without id removes nothing and loses
    nothing; rows that share an id do not remove from each other; other columns are
    not read.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")
    )
    keyed = settle(
        docs.where("id is not null")
        .select("text")
        .mapInArrow(tidy(_keys(window)), "route long, key long, doc long, n long, known boolean")
        .repartition("route")
        .sortWithinPartitions("known", "key", "doc")
        .mapInArrow(_shared, "key long, doc long, rows long"),
        "keys",
    )
    prints = settle(docs.mapInArrow(tidy(_printed), "id long, hash long, n_words long, sha string, doc long"), "prints")
    first = (
        prints.where("id is not null")
        .groupBy("sha")
        .agg(F.min("id").alias("first"), F.min("doc").alias("doc"))
    )
    shared = keyed.where("doc is not null").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    asked = first.join(shared, "doc").select(F.col("first").alias("id"), "sha", "keys")
    held = settle(
        docs.mapInArrow(tidy(_packed), "id long, hash long, n_words long, sha string, body binary").join(
            asked, ["id", "sha"]
        ),
        "passages",
    )
    hot = spark.sparkContext.broadcast(_hot(keyed))
    shards = max(
        spark.sparkContext.defaultParallelism,
        (held.agg(F.sum(F.size("keys"))).first()[0] or 0) // SHARD + 1,
    )
    answers = settle(
        held.select("id", "sha", "body", "keys")
        .mapInArrow(
            tidy(_segments(window, hot, shards * _CELLS)),
            "cell int, id long, words binary, width int, row array<string>, start array<int>",
        )
        .repartition(shards, "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(tidy(_matched(window)), "id long, row string, start int, end int")
        .groupBy("id", "row")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        .select(F.col("id").alias("i"), F.col("row").alias("r"), "spans"),
        "spans",
    )
    found = (
        held.select("id", "hash", "n_words", "sha", "body")
        .join(answers, (F.col("id") == F.col("i")) & (F.col("sha") == F.col("r")))
        .select("id", "hash", "n_words", "body", "spans")
        .mapInArrow(
            tidy(_cut),
            "id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept_text string",
        )
    )
    rest = (
        prints.join(first.select("sha", "first"), "sha", "left")
        .join(
            answers.select("i", "r"), (F.col("id") == F.col("i")) & (F.col("sha") == F.col("r")), "left_anti"
        )
        .withColumn("copy", F.coalesce((F.col("id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False)))
        .select(
            "id",
            F.col("hash").alias("text_hash"),
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
            F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest()))
            .otherwise(F.col("sha"))
            .alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).alias("kept_text"),
        )
    )
    return found.unionByName(rest).withColumnRenamed("id", id)


def _doc(body: bytes) -> int:
    """A document's name among the keys: equal words, equal name."""
    return int.from_bytes(hashlib.sha256(body).digest()[:8], "little", signed=True)


def _keys(window: int):
    """Keys of each document; of those that several documents of the task hold, one
    row goes to the key and the rest, whose answer is known, to their document."""

    def run(batches: Iterator[pa.RecordBatch]):
        keys, ids, held = [], [], 0
        hashes, docs, waiting = [], [], 0
        seen: set[int] = set()

        def settle_texts() -> int:
            sizes = np.array([len(h) for h in hashes])
            key, first, _ = minimizer_runs(np.concatenate(hashes), window, sizes)
            keys.append(key)
            ids.append(np.array(docs, np.int64)[np.searchsorted(np.cumsum(sizes), first, "right")])
            hashes.clear()
            docs.clear()
            return len(key)

        for (text,) in rows(batches):
            parts = words(text)
            doc = _doc(b" ".join(parts))
            if doc in seen:
                continue
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(doc)
            if len(parts) < window:
                continue
            hashes.append(word_hashes(parts))
            docs.append(doc)
            waiting += len(parts)
            if waiting >= _TOGETHER:
                held += settle_texts()
                waiting = 0
            if held >= 750_000:
                yield _key_rows(keys, ids)
                keys.clear()
                ids.clear()
                held = 0
        if hashes:
            held += settle_texts()
        if held:
            yield _key_rows(keys, ids)

    return run


def _key_rows(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    key, id = signed(np.concatenate(keys)), np.concatenate(ids)
    order = np.lexsort((id, key))
    key, id = key[order], id[order]
    once = np.append(True, (key[1:] != key[:-1]) | (id[1:] != id[:-1]))
    key, id = key[once], id[once]
    new = np.append(True, key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    several = np.maximum.reduceat(id, starts) != np.minimum.reduceat(id, starts)
    known = several[np.cumsum(new) - 1]
    # The first and last row of a shared key tell the others that it is shared, and together
    # how many documents hold it.
    last = np.append(new[1:], True)
    tells = known & (new | last)
    n = np.ones(len(key), np.int64)
    n[starts] += np.where(several, np.diff(np.append(starts, len(key))) - 2, 0)
    route = np.where(known, id, key)
    return pa.record_batch(
        {
            "route": np.concatenate([route, key[tells]]),
            "key": np.concatenate([key, key[tells]]),
            "doc": np.concatenate([id, id[tells]]),
            "n": np.concatenate([np.ones(len(key), np.int64), n[tells]]),
            "known": np.concatenate([known, np.zeros(int(tells.sum()), bool)]),
        }
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that at least two documents hold; one more row for a hot key."""
    rest = None
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in ("key", "doc", "n")]
        known = batch.column("known").to_numpy(zero_copy_only=False)
        if known.any():
            yield _shared_rows(now[0][known], now[1][known])
            now = [c[~known] for c in now]
        if not len(now[0]):
            continue
        if rest is not None:
            now = [np.append(a, b) for a, b in zip(rest, now, strict=True)]
        key = now[0]
        start = int(np.searchsorted(key, key[-1]))
        if len(key) - start > HOT and start == 0:
            # A hot key that goes on: what is known to be shared need not wait.
            start = len(key) - 2
        if start:
            yield _shared_groups(*(c[:start] for c in now))
        rest = [c[start:] for c in now]
    if rest is not None:
        yield _shared_groups(*rest)


def _shared_groups(key: np.ndarray, id: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    several = np.maximum.reduceat(id, starts) != np.minimum.reduceat(id, starts)
    kept = np.repeat(several, np.diff(np.append(starts, len(key))))
    counts = np.add.reduceat(n, starts)
    hot = counts >= HOT - 2
    return _shared_rows(key[kept], id[kept], key[starts[hot]], counts[hot])


def _shared_rows(key, id, hot=(), count=()) -> pa.RecordBatch:
    none = [None] * len(hot)
    return pa.record_batch(
        {
            "key": pa.array(np.append(key, np.asarray(hot, np.int64)), pa.int64()),
            "doc": pa.array([*id.tolist(), *none], pa.int64()),
            "rows": pa.array([*[None] * len(key), *map(int, count)], pa.int64()),
        }
    )


def _hot(keyed: DataFrame) -> bytes:
    """Slots that hold a hot key; their number does not depend on the data."""
    slot = F.expr(f"key & {(1 << _HOT_BITS) - 1}").cast("int")
    slots = keyed.where("doc is null").select(slot.alias("slot")).distinct().toArrow()
    out = np.zeros(1 << _HOT_BITS, np.uint8)
    out[slots["slot"].to_numpy()] = 1
    return out.tobytes()


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for id, text, mark in rows(batches):
        parts = words(text)
        body = b" ".join(parts)
        out.append((id, mark, len(parts), hashlib.sha256(body).hexdigest(), _doc(body)))
        if len(out) >= 4096:
            yield _columns(out, _PRINTS)
            out = []
    if out:
        yield _columns(out, _PRINTS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    out = []
    for id, text, mark in rows(batches):
        parts = words(text)
        body = b" ".join(parts)
        out.append((id, mark, len(parts), hashlib.sha256(body).hexdigest(), press.compress(body)))
        if len(out) >= 1024:
            yield _columns(out, _PACKED)
            out = []
    if out:
        yield _columns(out, _PACKED)


_PRINTS = pa.schema(
    [
        ("id", pa.int64()),
        ("hash", pa.int64()),
        ("n_words", pa.int64()),
        ("sha", pa.string()),
        ("doc", pa.int64()),
    ]
)
_PACKED = pa.schema(
    [
        ("id", pa.int64()),
        ("hash", pa.int64()),
        ("n_words", pa.int64()),
        ("sha", pa.string()),
        ("body", pa.binary()),
    ]
)
_SEGMENTS = pa.schema(
    [
        ("cell", pa.int32()),
        ("id", pa.int64()),
        ("words", pa.binary()),
        ("width", pa.int32()),
        ("row", pa.list_(pa.string())),
        ("start", pa.list_(pa.int32())),
    ]
)
_ANSWERS = pa.schema(
    [("id", pa.int64()), ("row", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
)
_CUT = pa.schema(
    [
        ("id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept_text", pa.string()),
    ]
)


def _columns(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
        schema=schema,
    )


def _segments(window: int, hot, cells: int):
    """Segments of shared keys by cell; equal ones of the task are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]):
        is_hot = np.frombuffer(hot.value, np.uint8)
        open_ = zstandard.ZstdDecompressor()
        groups: dict[tuple[int, bytes], list] = {}
        for id, sha, body, keys in rows(batches):
            w = word_hashes(open_.decompress(body).split())
            key, first, last = minimizer_runs(w, window)
            chosen = np.isin(key, np.array(keys, np.int64).view(np.uint64))
            symbols = np.ascontiguousarray(w.view(np.uint8).reshape(-1, 8)[:, :SYMBOL])
            single = is_hot[(key & np.uint64((1 << _HOT_BITS) - 1)).astype(np.int64)] > 0
            whole = chosen & ~single
            homes = (key % np.uint64(cells)).astype(np.int64)
            data = symbols.tobytes()
            spans = list(zip(homes[whole].tolist(), first[whole].tolist(), last[whole].tolist(), strict=True))
            apart = np.flatnonzero(chosen & single)
            if len(apart):
                own = window_hashes(w, window) % np.uint64(cells)
                for r in apart.tolist():
                    spans += [(int(own[i]), i, i) for i in range(first[r], last[r] + 1)]
            for home, a, z in spans:
                part = data[a * SYMBOL : (z + window) * SYMBOL]
                groups.setdefault((home, part), []).append((id, sha, a))
            if len(groups) >= 200_000:
                yield from _segment_rows(groups, cells)
                groups = {}
        if groups:
            yield from _segment_rows(groups, cells)

    return run


def _segment_rows(groups: dict, cells: int) -> Iterator[pa.RecordBatch]:
    out = []
    for (home, part), held in groups.items():
        width = len(part) // SYMBOL
        least = min(h[0] for h in held)
        mine = [h for h in held if h[0] == least]
        out.append((home, least, part, width, [h[1] for h in mine], [h[2] for h in mine]))
        if len(mine) < len(held):
            for id, sha, a in held:
                if id != least:
                    out.append((id % cells, id, None, width, [sha], [a]))
        if len(out) >= 8192:
            yield _columns(out, _SEGMENTS)
            out = []
    if out:
        yield _columns(out, _SEGMENTS)


def _matched(window: int):
    """The task: indexes the segments of some cells at a time and streams them through it.

    Rows come in the order of their cells.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        out, held, n, last = [], [], 0, None
        for batch in batches:
            indexed = pc.is_valid(batch.column("words"))
            known = batch.filter(pc.invert(indexed)).select(["id", "width", "row", "start"])
            for id, width, row, start in rows([known]):
                out += [(id, r, a, a + width) for r, a in zip(row, start, strict=True)]
                if len(out) >= 8192:
                    yield _columns(out, _ANSWERS)
                    out = []
            batch = batch.filter(indexed)
            if not batch.num_rows:
                continue
            cell, done = batch.column("cell").to_numpy(), 0
            for at in np.flatnonzero(np.append(cell[0] != last, cell[1:] != cell[:-1])).tolist():
                if n + at - done >= _INDEXED:
                    yield from _answers([*held, batch.slice(done, at - done)], window)
                    held, n, done = [], 0, at
            held.append(batch.slice(done))
            n, last = n + batch.num_rows - done, cell[-1]
        if held:
            yield from _answers(held, window)
        if out:
            yield _columns(out, _ANSWERS)

    return run


def _answers(batches: list[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    held = pa.Table.from_batches(batches)
    spans = list(_earlier(held.column("id").to_numpy(), held.column("words").to_pylist(), window))
    held = held.select(["id", "row", "start"])
    for at in range(0, len(spans), 8192):
        some, out = spans[at : at + 8192], []
        asked = held.take(pa.array([s for s, _, _ in some], pa.int64()))
        for (_, a, z), (id, row, start) in zip(some, rows(asked.to_batches()), strict=True):
            out += [(id, r, b + a, b + z) for r, b in zip(row, start, strict=True)]
        yield _columns(out, _ANSWERS)


def _earlier(ids: np.ndarray, parts: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """Segment and words covered by windows that a segment of a smaller id holds too."""
    sizes = np.array([len(p) // SYMBOL for p in parts])
    segments = np.split(_symbols(b"".join(parts)), np.cumsum(sizes)[:-1])
    index = SegmentIndex(segments, window)
    counts = sizes - window + 1
    segment = np.repeat(np.arange(len(segments)), counts)
    within = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    length, low, high = index.matches(index.starts[segment] + within, window)
    full = np.flatnonzero(length == window)
    if not len(full):
        return
    first = index.smallest(low[full], high[full], ids)
    gone = full[first < ids[segment[full]]]
    if not len(gone):
        return
    breaks = np.flatnonzero((np.diff(gone) != 1) | (np.diff(segment[gone]) != 0)) + 1
    starts, ends = np.append(0, breaks), np.append(breaks, len(gone)) - 1
    yield from zip(
        segment[gone[starts]].tolist(),
        within[gone[starts]].tolist(),
        (within[gone[ends]] + window).tolist(),
        strict=True,
    )


def _symbols(part: bytes) -> np.ndarray:
    six = np.frombuffer(part, np.uint8).reshape(-1, SYMBOL)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :SYMBOL] = six
    return out.view(np.uint64)[:, 0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    out = []
    for id, mark, n_words, body, spans in rows(batches):
        parts = open_.decompress(body).split()
        gone = np.zeros(len(parts) + 1, np.int64)
        for span in spans:
            gone[span["start"]] += 1
            gone[span["end"]] -= 1
        stays = np.cumsum(gone[:-1]) == 0
        kept = b" ".join(p for p, s in zip(parts, stays.tolist(), strict=True) if s)
        removed = int(len(parts) - stays.sum())
        out.append((id, mark, n_words, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
        if len(out) >= 512:
            yield _columns(out, _CUT)
            out = []
    if out:
        yield _columns(out, _CUT)
