"""N-gram Jaccard join: a T-occurrence search over inverted lists of rare shingles.

Two documents whose shingle sets overlap by the fraction ``t`` share at least ``k`` of
their ``n - ceil(t n) + k`` rarest shingles, whatever the common order of shingles is.
So the inverted lists hold these alone: the short lists of the search.  A query merges
its short lists with a heap that skips (DivideSkip, which probes the longest of them
by bisection); the shingles left out, which are those with long lists, are probed by
bisection in the sorted set of each document found.

Documents with equal sets are one node.  Nodes are first tied to the hub of their
lists (the node with the longest lists, which in a group of near copies is the text
nearest to all) and to the smallest node they meet, if they are really linked; the
search is then run between different components only, so a large group of near copies
costs links, not pairs.  What a pair must share follows from both sizes: sets of equal
size may differ in a seventh of their shingles only.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.llm.components import components
from areacast.llm.text import (
    list_array,
    mix,
    rows,
    signed,
    tidy,
    window_hashes,
    word_hashes,
    words,
)
from areacast.sources.shared import settle

#: Slots of the table that tells how frequent a shingle is.  It decides the order of
#: shingles only, never a result, and its size does not depend on the data.
ORDER_BITS = 22
#: A shingle counts as frequent from so many documents of one task.
FREQUENT = 2
#: Bits of the table that tells which documents' texts to send.  It affects what is
#: sent only, never a result, and its size does not depend on the data.
PICK_BITS = 25
#: Documents in one part of an inverted list, as a power of two.
PART_BITS = 11
#: ``least_shared``, ``n - rare_count`` and ``shared`` (by these) in SQL.
LEAST_SHARED = "n div 64"
COMMON = "greatest(0, ({n} * {percent} + 99) div 100 - 1 - {n} div 64)"
SHARED = "({percent} * (n + x.n) + 99 + {percent}) div (100 + {percent}) - greatest(common, x.common)"
#: Nodes of one component in a list from which they are a list of their own.
LARGE = 64


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence is one if it is shorter."""
    w = word_hashes(words(text, lower=True))
    return np.unique(window_hashes(w, min(size, len(w)))) if len(w) else w


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it is linked to."""
    return -(-n * percent // 100)


def extension(n: int) -> int:
    """Shared rare shingles asked of a pair; grows with the size."""
    return 1 + n // 64


def rare_count(n: int, percent: int) -> int:
    return min(n, n - required(n, percent) + extension(n))


def shared(n: int, m: int, percent: int) -> int:
    """Least number of rare shingles that linked sets of ``n`` and ``m`` have in common.

    They share ``both`` shingles at least, so all but ``n - both`` of the rare ones of
    one set are in the other, and these are the rarest of what the sets share.
    """
    both = -(-percent * (n + m) // (100 + percent))
    return both - max(n - rare_count(n, percent), m - rare_count(m, percent))


def fits(n: int, m: int, percent: int) -> bool:
    return 100 * min(n, m) >= percent * max(n, m)


def least_shared(n: int) -> int:
    """What a set of ``n`` has in common with any set it is linked to, at least.

    ``shared`` is ``extension`` of the larger set, less one where the number of rare
    shingles of the smaller set is rounded up.
    """
    return extension(n) - 1


def divide_skip(lists: list[list[int]], least: int) -> list[int]:
    """Ids in at least ``least`` of the sorted ``lists``."""
    return [id for id, _ in occurrences(lists, least)]


def occurrences(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """Ids in at least ``least`` of the sorted ``lists``, and in how many.

    The longest lists are set aside, ``least - 1`` at most; the others are merged
    with a heap that skips ids which cannot reach the rest of the threshold, and the
    ids found are probed in the long lists by bisection.
    """
    lists = sorted((x for x in lists if x), key=len, reverse=True)
    if not lists:
        return []
    aside = min(least - 1, int(least / (0.01 * math.log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:aside], lists[aside:]
    need = least - len(long)
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap))
        count, target = len(taken), top + 1
        if count < need:
            while len(taken) < need - 1 and heap:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(target, heap[0][0])
        else:
            for x in long:
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= least:
                found.append((top, count))
        for _, i, at in taken:
            at = bisect_left(short[i], target, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    return found


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75,
    hashed: bool = False,
) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``, if ``hashed`` with
    ``text_hash``, the xxhash64 of its text.

    Two rows are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    ``size``-word shingles (A-Z folded).  ``component_id`` is the smallest id that
    links reach, the row's own included.  A missing or empty text has 0 shingles and
    no links; a row without id takes no part and gets no component; of rows that share
    an id, each is judged by its own text.  Other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    scanned = settle(
        (docs.withColumn("text_hash", F.xxhash64("text")) if hashed else docs).mapInArrow(
            tidy(_scan(size)),
            "id long, n long, key binary, node long, shingle long, docs long, is_doc boolean, text_hash long",
        ),
        "sets",
    )
    prints = scanned.where("is_doc").select("id", "n", "key", "node", "text_hash")
    order = spark.sparkContext.broadcast(_order(scanned.where("not is_doc")))
    classes = settle(
        prints.where("n > 0 and id is not null")
        .groupBy("key")
        .agg(*(F.min(c).alias(c) for c in ("id", "n", "node"))),
        "classes",
    )
    lists = settle(
        docs.where("id is not null")
        .mapInArrow(tidy(_postings(size, percent, order)), "shingle long, part int, node long")
        .repartition("shingle", "part")
        .sortWithinPartitions("shingle", "part", "node")
        .mapInArrow(_lists, "shingle long, part int, nodes array<long>"),
        "lists",
    )
    sizes = classes.groupBy("node").agg(F.min("n").alias("n"), F.min("id").alias("id"))
    held = settle(_held(lists, sizes), "held")
    verified = _Verify(docs.where("id is not null"), classes, size, percent)
    near = settle(verified.links(_pivots(held), "tied"), "near")
    first = settle(components(near), "first")
    rest = settle(verified.links(_search(held, first, percent), "found"), "rest")
    final = components(near.unionByName(rest))
    named = sizes.join(final, "node", "left").select(
        "node", "id", F.coalesce("label", "node").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_key = (
        classes.select("key", "node")
        .join(named.join(smallest, "label").select("node", "component_id"), "node")
        .select("key", "component_id")
    )
    return prints.drop("node").join(by_key, "key", "left").select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.coalesce(
            F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id")
        ).alias("component_id"),
        *(["text_hash"] if hashed else []),
    )


def _scan(size: int):
    """A row for each document, and the shingles that many documents of a task hold."""

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        kept = counts >= FREQUENT
        n = int(kept.sum())
        return _scan_rows(
            [None] * n, [None] * n, [None] * n, [None] * n, signed(values[kept]), counts[kept], [False] * n
        )

    def run(batches: Iterator[pa.RecordBatch]):
        sets, held, out = [], 0, ([], [], [], [])
        seen: set[bytes] = set()
        for id, text, *text_hash in rows(batches):
            s = shingle_set(text, size)
            key = set_key(s) if len(s) else None
            out[0].append(id)
            out[1].append(len(s))
            out[2].append(key)
            out[3].append(text_hash[0] if text_hash else None)
            if key and key not in seen:
                seen.add(key)
                sets.append(s)
                held += len(s)
            if len(out[0]) >= 4096:
                n = len(out[0])
                yield _scan_rows(*out, [None] * n, [None] * n, [True] * n)
                out = ([], [], [], [])
            if held >= 3_000_000:
                yield frequent(sets)
                sets, held = [], 0
                seen.clear()
        if out[0]:
            n = len(out[0])
            yield _scan_rows(*out, [None] * n, [None] * n, [True] * n)
        if held:
            yield frequent(sets)

    return run


def _scan_rows(id, n, key, text_hash, shingle, docs, is_doc) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "id": pa.array(id, pa.int64()),
            "n": pa.array(n, pa.int64()),
            "key": pa.array(key, pa.binary()),
            "node": pa.array([k and node_of(k) for k in key], pa.int64()),
            "shingle": pa.array(shingle, pa.int64()),
            "docs": pa.array(docs, pa.int64()),
            "is_doc": pa.array(is_doc, pa.bool_()),
            "text_hash": pa.array(text_hash, pa.int64()),
        }
    )


def _order(frequent: DataFrame) -> bytes:
    """For each slot, the power of two of its most frequent shingle's documents."""
    slots = (
        frequent.groupBy("shingle")
        .agg(F.sum("docs").alias("docs"))
        .groupBy(F.expr(f"shingle & {(1 << ORDER_BITS) - 1}").cast("int").alias("slot"))
        .agg(F.floor(F.log2(F.max("docs"))).cast("byte").alias("rank"))
        .toArrow()
    )
    order = np.zeros(1 << ORDER_BITS, np.uint8)
    order[slots["slot"].to_numpy()] = slots["rank"].to_numpy()
    return order.tobytes()


def _postings(size: int, percent: int, order):
    """The rarest shingles of each set; equal sets of a task count once."""

    def run(batches: Iterator[pa.RecordBatch]):
        ranks = np.frombuffer(order.value, np.uint8)
        seen: set[int] = set()
        out, held = [], 0
        for _, text in rows(batches):
            s = shingle_set(text, size)
            if not len(s):
                continue
            node = node_of(set_key(s))
            if node in seen:
                continue
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(node)
            rank = ranks[(s & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)]
            rare = rare_count(len(s), percent)
            if rank.any():
                s = s[np.argsort(rank, kind="stable")]
                rank = np.sort(rank)
            s, rank = s[:rare], rank[:rare].astype(np.int64)
            parts = np.left_shift(1, np.maximum(0, rank - PART_BITS))
            at = int(mix(np.array([node], np.int64).view(np.uint64))[0] >> np.uint64(1))
            part = np.where(parts > 1, 1 + at % parts, 0)
            out.append((signed(s), part, np.full(len(s), node, np.int64)))
            held += len(s)
            if held >= 200_000:
                yield _posting_rows(out)
                out, held = [], 0
        if out:
            yield _posting_rows(out)

    return run


def _posting_rows(out) -> pa.RecordBatch:
    s, part, node = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.record_batch({"shingle": s, "part": part.astype(np.int32), "node": node})


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists from sorted postings; a shingle of one node has none."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        starts = _starts(now[0], now[1])
        if len(starts) > 1:
            yield _list_rows([c[: starts[-1]] for c in now])
        rest = [c[starts[-1] :] for c in now] if len(starts) else None
    if rest is not None:
        yield _list_rows(rest)


def _starts(*keys: np.ndarray) -> np.ndarray:
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _list_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    shingle, part, node = (c[_starts(*columns)] for c in columns)
    starts = _starts(shingle, part)
    counts = np.diff(np.append(starts, len(shingle)))
    kept = (counts >= 2) | (part[starts] > 0)
    inside = np.repeat(kept, counts)
    return pa.record_batch(
        {
            "shingle": shingle[starts[kept]],
            "part": part[starts[kept]],
            "nodes": list_array(node[inside], np.append(0, np.cumsum(counts[kept]))),
        }
    )


def _held(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lists, of nodes with their size, number of lists and all their lengths.

    A node in fewer lists than it must share with any other has no link, so no place.
    """
    held = lists.select("shingle", "part", F.explode("nodes").alias("node"), F.size("nodes").alias("held"))
    nodes = (
        held.groupBy("node")
        .agg(F.sum("held").alias("weight"), F.count("*").alias("lists"))
        .join(sizes.select("node", "n"), "node")
        .where(F.col("lists") >= F.expr(LEAST_SHARED))
    )
    return _grouped(held.drop("held").join(nodes, "node"), "node", "n", "weight", "lists").where(
        (F.col("part") > 0) | (F.size("met") > 1)
    )


def _grouped(held: DataFrame, *columns: str) -> DataFrame:
    """Lists of nodes again.  A part is bounded, so its nodes may meet in one task."""
    return (
        held.repartition("shingle", "part")
        .groupBy("shingle", "part")
        .agg(F.collect_list(F.struct(*columns)).alias("met"))
    )


def _pivots(held: DataFrame) -> DataFrame:
    """Each node with the hub and the smallest node that it meets most often in its lists."""
    held = held.select(
        "shingle", "part", "met",
        F.array_min("met.node").alias("low"),
        F.array_max(F.transform("met", lambda x: F.struct(x["weight"], x["node"]))).alias("hub"),
    )
    parts = held.where("part > 0")
    ends = parts.groupBy("shingle").agg(F.min("low").alias("low"), F.max("hub").alias("hub"))
    return (
        held.where("part = 0")
        .drop("part")
        .unionByName(parts.drop("part", "low", "hub").join(ends, "shingle"))
        .select(F.explode("met.node").alias("a"), F.array("low", "hub.node").alias("ends"))
        .select("a", F.posexplode("ends").alias("end", "b"))
        .where("a != b")
        .groupBy("a", "end", "b")
        .count()
        .groupBy("a", "end")
        .agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        .select("a", "b")
        .distinct()
    )


class _Verify:
    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs ``a, b`` that are linked, by the whole sets of both.

        The pairs are written first, and their texts are picked in the scan of the
        documents, so that hardly any others are shuffled.
        """
        size, percent = self.size, self.percent
        sizes = self.classes.groupBy("node").agg(F.min("n").alias("n"))
        for end in "ab":
            pairs = pairs.join(
                sizes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end
            )
        close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        pairs = settle(pairs.where(close).select("a", "b"), name)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = settle(
            self.classes.join(ends, "node").select("node", "id").distinct(), f"{name}_ends"
        )
        for end in "ab":
            pairs = pairs.join(asked.select(F.col("node").alias(end), F.col("id").alias(f"id_{end}")), end)
        texts = _picked(self.docs, asked)
        for end in "ab":
            pairs = pairs.join(
                texts.select(F.col("id").alias(f"id_{end}"), F.col("text").alias(f"text_{end}")),
                f"id_{end}",
            )
        return (
            pairs.select("a", "b", "text_a", "text_b")
            .mapInArrow(_probe(size, percent), "a long, b long")
            .distinct()
        )


def _picked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have an id of ``asked``, by a table of its ids' hashes."""
    hashed = F.xxhash64("id").alias("hash")
    slots = (
        asked.select(hashed)
        .groupBy(F.expr(f"cast(shiftrightunsigned(hash, {64 - PICK_BITS + 6}) as int)").alias("slot"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(hash & 63 as int)))").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (PICK_BITS - 6), np.uint64)
    table[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def pick(batches: Iterator[pa.RecordBatch]):
        table = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            there = table[h >> np.uint64(64 - PICK_BITS + 6)] >> (h & np.uint64(63)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(there.astype(bool)))

    docs = docs.select("id", "text")
    return docs.select("id", "text", hashed).mapInArrow(tidy(pick), docs.schema)


def _probe(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray | None] = {}

        def of(node: int, text: str) -> np.ndarray | None:
            if node not in held:
                if len(held) >= 64:
                    held.clear()
                s = shingle_set(text, size)
                held[node] = s if node_of(set_key(s)) == node else None
            return held[node]

        a_out, b_out = [], []
        for a, b, text_a, text_b in rows(batches):
            y, x = of(b, text_b), of(a, text_a)
            if x is None or y is None:
                held.clear()
                continue
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                a_out.append(a)
                b_out.append(b)
        yield pa.record_batch({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _search(held: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components that share enough rare shingles.

    A list is sent to a query without the nodes that cannot be its partners: those of an
    unfit size, and those with whom it must share more lists than one of the two is in.
    A list in one part is answered where it stands; parts of one list meet by shingle.
    """
    common = F.expr(COMMON.format(n="n", percent=percent)).alias("common")
    lists = settle(
        held.select("shingle", "part", F.inline("met"))
        .join(first, "node", "left")
        .select("shingle", "part", "node", "n", "lists", F.coalesce("label", "node").alias("label"))
        .repartition("shingle", "part")
        .groupBy("shingle", "part", "label")
        .agg(F.collect_list(F.struct("node", "n", "lists", common, "label")).alias("met"))
        .groupBy("shingle", "part")
        .agg(F.collect_list(F.struct("label", "met")).alias("labels"))
        .where((F.col("part") > 0) | (F.size("labels") > 1)),
        "mixed",
    )
    whole = lists.where("part = 0").select("shingle", "labels", F.inline("labels").alias("label", "own"))
    others = "flatten(transform(filter(labels, x -> x.label > label), x -> x.met))"
    may = f"""filter(met, x -> x.label > label
        and 100 * least(n, x.n) >= {percent} * greatest(n, x.n)
        and {SHARED.format(percent=percent)} <= least(lists, x.lists))"""
    return (
        whole.select("shingle", "own", F.expr(others).alias("met"))
        .where(F.size("met") > 0)
        .select("shingle", "met", F.inline("own"))
        .unionByName(_parts_met(lists.where("part > 0")))
        .withColumn("met", F.expr(may))
        .where(F.size("met") > 0)
        .select("node", "n", "shingle", F.col("met.node").alias("nodes"), F.col("met.n").alias("sizes"))
        .repartition("node")
        .sortWithinPartitions("node", "shingle")
        .mapInArrow(_merge(percent), "a long, b long")
    )


def _parts_met(lists: DataFrame) -> DataFrame:
    """Each node of the lists in several parts, with the nodes of any one part."""
    lists = lists.select("shingle", "part", F.inline("labels"))
    mixed = (
        lists.groupBy("shingle")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low != high")
        .select("shingle")
    )
    lists = lists.join(mixed, "shingle")
    large = F.size("met") >= LARGE
    apart = lists.where(large).select("shingle", F.col("label").alias("other"), "met")
    together = (
        lists.where(~large)
        .groupBy("shingle", "part")
        .agg(F.flatten(F.collect_list("met")).alias("met"))
        .drop("part")
    )
    asked = lists.select("shingle", F.inline("met"))
    return asked.join(together, "shingle").unionByName(
        asked.join(apart, "shingle").where("other > label").drop("other")
    )


def _merge(percent: int):
    """The search itself: one query's lists stand together, in the order of queries."""

    def answer(node: int, n: int, lists: list[list[int]], size_of: dict[int, int]):
        need = {m: shared(n, m, percent) for m in set(size_of.values())}
        found = occurrences(lists, min(need.values(), default=1))
        return _pairs(node, [b for b, count in found if count >= need[size_of[b]]])

    def run(batches: Iterator[pa.RecordBatch]):
        node, of, lists, last, size_of = None, 0, [], None, {}
        for q, n, shingle, nodes, sizes in rows(batches):
            if q != node:
                if node is not None:
                    yield answer(node, of, lists, size_of)
                node, of, lists, last, size_of = q, n, [], None, {}
            size_of.update(zip(nodes, sizes, strict=True))
            if shingle == last:
                lists[-1] = sorted(lists[-1] + nodes)
            else:
                lists.append(sorted(nodes))
            last = shingle
        if node is not None:
            yield answer(node, of, lists, size_of)

    return run


def _pairs(node: int, found: list[int]) -> pa.RecordBatch:
    return pa.record_batch(
        {"a": pa.array([node] * len(found), pa.int64()), "b": pa.array(found, pa.int64())}
    )
