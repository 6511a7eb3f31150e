"""Independent columns of a design with two long factors, without a matrix over their levels.

Combinations of columns that vanish on every row are spanned by three kinds:

- for each connected component of the graph that joins levels met in one row, its
  levels of one factor less its levels of the other;
- the intercept less all levels of the first factor;
- combinations of the other columns that equal a sum of one effect of each factor.

A column is aliased if it is the last, in reading order, with a place in such a
combination.  The first kind touches each level once, so elimination has one pivot a
component and otherwise few dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.models.gram import GROUP_BLOCK, HELD_GROUP_SUMS, Layout, _hold, accumulate
from areacast.sources.shared import settle

# Forests of levels that meet in one task of a merging round.
MERGED = 8
# Doubles of level values that are sent to tasks at once.
SENT = 8_000_000
# Entries of a combination below this are rounding.
ENTRY_TOLERANCE = 1e-6


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (the smallest node of each node's component) after adding edges x-y."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def level_components(pairs: DataFrame, nodes: int) -> np.ndarray:
    """The smallest node of each node's component, from edges ``x, y``.

    A task turns its edges into one edge for each node met, to the smallest node of its
    component there.  These do not depend on the order of rows, and few of them are left
    to merge: what the driver receives is bounded by the number of nodes.
    """

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = np.arange(nodes)
        for b in batches:
            root = joined(root, b["x"].to_numpy(np.int64), b["y"].to_numpy(np.int64))
        moved = np.flatnonzero(root != np.arange(nodes))
        for at in range(0, len(moved), 100_000):
            some = moved[at : at + 100_000]
            yield pd.DataFrame({"x": some, "y": root[some]})

    edges = settle(pairs.select("x", "y").mapInPandas(stars, "x long, y long"), "stars")
    tasks = edges.rdd.getNumPartitions()
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        edges = settle(edges.repartition(tasks, "x").mapInPandas(stars, "x long, y long"), "stars")
    left = edges.toPandas()
    return joined(np.arange(nodes), left["x"].to_numpy(np.int64), left["y"].to_numpy(np.int64))


def neighbour_sums(pairs: DataFrame, values: np.ndarray) -> np.ndarray:
    """For each node, the values of its neighbours times the weight ``n`` of the edge."""
    width = max(1, SENT // len(values))
    parts = [_neighbour_sums(pairs, values[:, i : i + width]) for i in range(0, values.shape[1], width)]
    return np.hstack(parts)


def _neighbour_sums(pairs: DataFrame, values: np.ndarray) -> np.ndarray:
    sent = pairs.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, held = sent.value, {}

        def frame():
            out = pd.DataFrame({"block": list(held), "sums": [s.ravel() for s in held.values()]})
            held.clear()
            return out

        for b in batches:
            x, y = b["x"].to_numpy(np.int64), b["y"].to_numpy(np.int64)
            n = b["n"].to_numpy(float)[:, None]
            ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            sums = np.zeros((len(ids), v.shape[1]))
            np.add.at(sums, at, np.vstack([n * v[y], n * v[x]]))
            _hold(held, ids, sums)
            if len(held) * GROUP_BLOCK * v.shape[1] > HELD_GROUP_SUMS:
                yield frame()
        if held:
            yield frame()

    rows = (
        pairs.mapInPandas(run, "block long, sums array<double>")
        .groupBy("block")
        .agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
        .collect()
    )
    sent.unpersist()
    out = np.zeros((-(-len(values) // GROUP_BLOCK) * GROUP_BLOCK, values.shape[1]))
    for r in rows:
        first = r["block"] * GROUP_BLOCK
        out[first : first + GROUP_BLOCK] = r["sums"].toArray().reshape(GROUP_BLOCK, -1)
    return out[: len(values)]


def level_effects(
    pairs: DataFrame, weight: np.ndarray, target: np.ndarray, tol: float = 1e-11, max_passes: int = 2000
) -> np.ndarray:
    """Effects of all levels of both factors that fit each column best, by least squares.

    ``target`` holds each column's sum by level.  Conjugate gradients, scaled by the
    weight of a level, one pass over the pairs of levels a step.
    """
    scale = np.where(weight > 0, weight, 1.0)[:, None]
    effects, left = np.zeros_like(target), target.copy()
    size = (left**2 / scale).sum(axis=0)
    goal = tol**2 * size
    step = left / scale
    for _ in range(max_passes):
        if (size <= goal).all():
            return effects
        moved = scale * step + neighbour_sums(pairs, step)
        along = (step * moved).sum(axis=0)
        live = (size > goal) & (along > 0)
        rate = np.where(live, size / np.where(live, along, 1.0), 0.0)
        effects, left = effects + rate * step, left - rate * moved
        now = np.where(live, (left**2 / scale).sum(axis=0), 0.0)
        step = left / scale + np.where(live, now / np.where(live, size, 1.0), 0.0) * step
        size = now
    raise RuntimeError(f"level effects of two factors not found in {max_passes} passes")


def independent_of_two(design, coded: DataFrame, first: str, second: str, tolerance: float) -> tuple[int, ...]:
    """Columns, read in order, that are not a combination of those before them.

    ``coded`` is settled: it is read several times.
    """
    names = (first, second)
    numbers = [design.index_column(t) for t in names]
    levels = [len(design.factors[t].levels) for t in names]
    shift, nodes = levels[0], sum(levels)
    pairs = settle(
        coded.groupBy(
            F.col(numbers[0]).cast("long").alias("x"), (F.col(numbers[1]).cast("long") + shift).alias("y")
        ).agg(F.sum("_n").alias("n")),
        "level_pairs",
    )
    component = level_components(pairs, nodes)
    others = [j for j, (t, _) in enumerate(design.columns) if t not in names]
    weight, ways, effects = _combinations(design, coded, pairs, numbers, levels, others, tolerance)

    # A row a column: its entries in the combinations of the second and third kind.
    entries = np.hstack([np.zeros((nodes, 1)), -effects @ ways])
    entries[:shift, 0] = -1.0
    place = {j: i for i, j in enumerate(others)}
    node = {}
    for t, below in zip(names, (0, shift)):
        last = [j for j, (term, _) in enumerate(design.columns) if term == t]
        node |= {j: below + i for i, j in enumerate(last)}
    order = design.reading_order()
    baselines = [levels[0] - 1, nodes - 1]
    pivots: dict[int, tuple[float, np.ndarray]] = {}
    basis, aliased = np.zeros((0, entries.shape[1])), set()
    for j in [None, None, *reversed(order)]:
        at = baselines.pop() if j is None else node.get(j)
        if at is None:
            row = np.append(0.0, ways[place[j]])
        elif weight[at] <= 0:
            aliased.add(j)
            continue
        else:
            sign, row, c = (1.0 if at < shift else -1.0), entries[at], int(component[at])
            if c not in pivots:
                pivots[c] = sign, row
                aliased.add(j)
                continue
            row = row - sign / pivots[c][0] * pivots[c][1]
        if len(basis) == basis.shape[1]:
            continue
        for _ in range(2):
            row = row - basis.T @ (basis @ row)
        size = np.linalg.norm(row)
        if size > ENTRY_TOLERANCE:
            basis = np.vstack([basis, row / size])
            aliased.add(j)
    return tuple(j for j in range(len(design.columns)) if j not in aliased)


def _combinations(design, coded, pairs, numbers, levels, others, tolerance):
    """Weights of the levels, combinations of the other columns that are sums of two level
    effects, and the effects of each column.  Columns are in units of their deviation."""
    numeric = [t for t in design.spec.fixed if t not in design.factors]
    means = [F.sum(F.col("_n") * F.col(t).cast("double")) / F.sum("_n") for t in numeric]
    centre = dict(zip(numeric, coded.agg(*means).first())) if numeric else {}
    layout = Layout(
        tuple(t for t in design.layout().terms if t[0] not in numbers),
        centre=tuple((t, m, 1.0) for t, m in centre.items()),
    )
    weight, by_level = [], []
    for number, count in zip(numbers, levels):
        none = np.zeros((count, 1))
        found = accumulate(
            coded, layout.but(group=number), "gaussian", np.zeros(layout.width), none, none[:, :, None]
        )
        weight.append(found.group_cross[:, 0, 0])
        by_level.append(found.group_fixed[:, 1:, 0])
    weight, cross = np.concatenate(weight), found.cross
    total, mean = cross[0, 0], cross[0, 1:] / cross[0, 0]
    variance = np.diag(cross)[1:] / total - mean**2
    middle = np.array([centre.get(design.columns[j][0], 0.0) for j in others])
    varies = variance > 1e-13 * np.maximum(np.diag(cross)[1:] / total + middle**2, 1e-300)
    unit = np.where(varies, np.sqrt(np.where(varies, variance, 1.0)), 1.0)
    corr = (cross[1:, 1:] / total - np.outer(mean, mean)) / np.outer(unit, unit)
    corr = corr * np.outer(varies, varies)
    target = (np.vstack(by_level) - weight[:, None] * mean) / unit * varies
    if not others:
        return weight, np.zeros((0, 0)), target
    effects = level_effects(pairs, weight, target)
    left = corr - target.T @ effects / total
    share, ways = np.linalg.eigh((left + left.T) / 2)
    return weight, ways[:, share < tolerance], effects
