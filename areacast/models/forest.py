"""Probability forest on weighted cells.

Every tree draws respondents, not cells: a cell enters it with Poisson numbers of its
supporters and opponents, seeded by the cell's values, the outcome and the tree, so that
draws are the same in any task.  Trees are grown on shares, to any depth.

While a node of any tree has more cells than a task should hold, all trees grow together
in Spark, one aggregation of (node, term, value) sums per depth.  The cells of smaller
nodes then go to one task each (or to one per block of trees), which grows what is left
of them in memory.  Every choice depends on the node's path alone, so where the border
lies changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areacast.models import trees as T
from areacast.models.design import Factor, factor_levels
from areacast.models.spec import ModelSpec, collapse, is_factor
from areacast.sources.shared import settle

#: Cells of a node that one task grows in memory.  Plan only.
LOCAL_CELLS = 200_000
#: Trees that one task grows side by side.
BLOCK = 16
#: Bytes of trees in one broadcast.
PART_BYTES = 64 * 1024 * 1024
_ALL = "all"


def _features(df: DataFrame, terms: Sequence[str], factors: Mapping[str, Factor]) -> DataFrame:
    """Columns ``_f_<number>``: text terms as level numbers in alphabetical order."""
    for i, t in enumerate(terms):
        if t in factors:
            model = StringIndexerModel.from_labels(list(factors[t].levels), f"_t_{i}", f"_f_{i}", "error")
            df = model.transform(df.withColumn(f"_t_{i}", F.col(t).cast("string"))).drop(f"_t_{i}")
        else:
            df = df.withColumn(f"_f_{i}", F.col(t).cast("double"))
    return df


@dataclass(frozen=True)
class ForestFit:
    """The trees are held by the driver and broadcast in parts, as in Spark ML."""

    spec: ModelSpec
    factors: Mapping[str, Factor]
    trees: T.Trees

    @cached_property
    def _parts(self) -> list[T.Trees]:
        """The trees in blocks of at most ``PART_BYTES`` (or one tree)."""
        size = self.trees.sizes() * 22
        number = np.cumsum(size) // PART_BYTES
        return [self.trees.some(np.flatnonzero(number == k)) for k in np.unique(number)]

    def score(self, frame: DataFrame, out: str = "predicted_probability") -> DataFrame:
        """Append the probability of outcome 1; an unseen level fails the job."""
        terms = self.spec.fixed
        parts = [frame.sparkSession.sparkContext.broadcast(p) for p in self._parts]
        count = len(self.trees.roots)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                x = batch.to_numpy(dtype=float)
                missing = np.isnan(x).any(axis=1)
                rows, at = np.unique(x[~missing], axis=0, return_inverse=True)
                total = sum(p.value.total(rows) for p in parts) / count
                value = np.full(len(x), np.nan)
                value[~missing] = total[at.ravel()]
                yield pd.Series(value).astype(object).where(~missing, None)

        udf = F.pandas_udf(run, "double")
        scored = _features(frame, terms, self.factors).withColumn(
            out, udf(F.struct(*[f"_f_{i}" for i in range(len(terms))]))
        )
        return scored.select(*[c for c in frame.columns if c != out], out)


def fit_forest(df: DataFrame, spec: ModelSpec, **kwargs) -> ForestFit:
    """Fit from respondents (or weighted rows); reduces them to cells first."""
    return fit_forest_cells(settle(collapse(df, spec), "cells"), spec, **kwargs)


def fit_forest_cells(cells: DataFrame, spec: ModelSpec, **kwargs) -> ForestFit:
    """Bagged trees on distinct cells (see ``fit_forests``)."""
    one = cells.withColumns({"_nf": F.array("_n"), "_sf": F.array("_s")})
    return fit_forests(one, spec, [_ALL], **kwargs)[_ALL]


def fit_forests(
    cells: DataFrame, spec: ModelSpec, names: Sequence, trees: int = 500, max_depth: int | None = None,
    seed: int = 42, tried: int | None = None, min_node: float = 1, bootstrap: bool = True,
    local_cells: int = LOCAL_CELLS,
) -> dict[object, ForestFit]:
    """A forest for each training set, all grown together.

    ``_nf`` and ``_sf`` hold a cell's respondents and supporters in each set of ``names``.
    A tree tries ``tried`` random terms at each split (floor(sqrt(p)) by default) and is
    split until a node's outcomes agree or it holds ``min_node`` respondents.  Without
    ``bootstrap`` each tree takes all respondents once.
    """
    if spec.family != "binomial" or spec.random:
        raise ValueError("fit_forest fits a binomial outcome without random terms")
    if not spec.fixed:
        raise ValueError("fit_forest needs at least one term")
    texts = [c for c in spec.fixed if is_factor(cells.schema, c, spec)]
    factors = factor_levels(cells, texts, spec)
    terms = len(spec.fixed)
    plan = _Plan(
        terms, len(names), trees, tried or max(1, math.isqrt(terms)),
        max_depth if max_depth is not None else 2**30, min_node, seed, bootstrap,
    )
    inputs = [f"_f_{i}" for i in range(terms)]
    coded = _features(cells, spec.fixed, factors).select(
        F.xxhash64(*inputs).alias("key"), F.array(*inputs).alias("x"),
        F.transform("_nf", lambda v: v.cast("double")).alias("n"),
        F.transform("_sf", lambda v: v.cast("double")).alias("s"),
    )
    size = cells.count()
    if not size:
        raise ValueError("no complete rows to fit")
    top = _Top.start(plan)
    if size > local_cells:
        _grow_top(coded, plan, top, size, local_cells)
    grown = _grow_rest(coded, plan, top, size > local_cells)
    return {
        name: ForestFit(spec, factors, grown.some(_drawn(grown, k * trees, trees)))
        for k, name in enumerate(names)
    }


def _drawn(grown: T.Trees, first: int, trees: int) -> np.ndarray:
    """Trees of a set; those that drew no respondent have nothing to say."""
    own = np.arange(first, first + trees)
    kept = own[~np.isnan(grown.value[own])]
    if not len(kept):
        raise ValueError("no respondents were drawn")
    return kept


@dataclass(frozen=True)
class _Plan:
    terms: int
    sets: int
    trees: int
    tried: int
    max_depth: int
    min_node: float
    seed: int
    bootstrap: bool

    @property
    def total(self) -> int:
        return self.sets * self.trees

    def drawn(self, key, n, s) -> tuple[np.ndarray, np.ndarray]:
        """Weight and hits of each cell in each tree of each set: (cells, sets * trees)."""
        if not self.bootstrap:
            return np.repeat(n, self.trees, axis=1), np.repeat(s, self.trees, axis=1)
        weight, hits = (np.empty((len(key), self.total)) for _ in range(2))
        for i, k in enumerate(key.tolist()):
            for f in range(self.sets):
                at = slice(f * self.trees, (f + 1) * self.trees)
                stream = 2 * (self.seed * 65_536 + f)
                hits[i, at] = T.poisson_draws(k, stream, s[i, f], self.trees)
                weight[i, at] = hits[i, at] + T.poisson_draws(k, stream + 1, n[i, f] - s[i, f], self.trees)
        return weight, hits


def _cells(plan: _Plan, batches: Iterator[pa.RecordBatch]):
    """Key, values and draws of a few thousand cells at a time."""
    step = max(1, 4_000_000 // plan.total)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            key = batch.column("key").to_numpy()
            x, n, s = (
                batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)
                for c in ("x", "n", "s")
            )
            yield x, *plan.drawn(key, n, s)


@dataclass
class _Top:
    """The upper part of all trees: those nodes that Spark splits."""

    trees: T.Trees
    paths: np.ndarray
    depth: np.ndarray
    tree: np.ndarray

    @classmethod
    def start(cls, plan: _Plan) -> _Top:
        every = np.arange(plan.total)
        nothing = np.full(plan.total, -1)
        trees = T.Trees(nothing.astype(np.int16), np.zeros(plan.total), nothing, np.full(plan.total, np.nan), every)
        return cls(trees, T.root_paths(every, plan.seed), np.zeros(plan.total, int), every)

    def split(self, node: int, term: int, cut: float) -> int:
        """Turns a leaf into a split; returns the number of its left child."""
        t, new = self.trees, len(self.trees.term)
        t.term[node], t.cut[node], t.left[node] = term, cut, new
        t.term = np.append(t.term, np.array([-1, -1], np.int16))
        t.cut, t.left = np.append(t.cut, [0.0, 0.0]), np.append(t.left, np.array([-1, -1], t.left.dtype))
        t.value = np.append(t.value, [np.nan, np.nan])
        self.paths = np.append(self.paths, T.child_paths(self.paths[node : node + 1]))
        self.depth = np.append(self.depth, [self.depth[node] + 1] * 2)
        self.tree = np.append(self.tree, [self.tree[node]] * 2)
        return new


def _level_sums(plan: _Plan, top):
    """Sums by open node, tried term and value, over the cells of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, open_, terms = top.value
        by_tree: dict[int, None] = dict.fromkeys(open_["tree"].tolist())
        place = np.full(len(t.term), -1)
        place[open_["node"]] = np.arange(len(open_["node"]))
        for x, weight, hits in _cells(plan, batches):
            for tree in by_tree:
                at = place[t.leaves(x, np.full(len(x), t.roots[tree]))]
                live = np.flatnonzero((at >= 0) & (weight[:, tree] > 0))
                if not len(live):
                    continue
                node = at[live]
                for j in range(terms.shape[1]):
                    value = x[live, terms[node, j]]
                    order = np.lexsort((value, node))
                    n, v = node[order], value[order]
                    first = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (v[1:] != v[:-1])))
                    yield pa.record_batch(
                        {
                            "node": open_["node"][n[first]].astype(np.int64),
                            "term": terms[n[first], j].astype(np.int32),
                            "value": v[first],
                            "w": np.add.reduceat(weight[live, tree][order], first),
                            "s": np.add.reduceat(hits[live, tree][order], first),
                            "cells": np.diff(np.append(first, len(n))).astype(np.int64),
                        }
                    )

    return run


def _grow_top(coded: DataFrame, plan: _Plan, top: _Top, size: int, local: int) -> None:
    """Splits every node of more than ``local`` cells, one depth of all trees a pass."""
    spark = coded.sparkSession
    open_ = np.arange(plan.total)
    while len(open_):
        terms = T.tried_terms(top.paths[open_], plan.terms, plan.tried)
        state = spark.sparkContext.broadcast((top.trees, {"node": open_, "tree": top.tree[open_]}, terms))
        sums = (
            coded.mapInArrow(
                _level_sums(plan, state), "node long, term int, value double, w double, s double, cells long"
            )
            .groupBy("node", "term", "value")
            .agg(*[F.sum(c).alias(c) for c in ("w", "s", "cells")])
        )
        by = W.partitionBy("node", "term")
        up = by.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
        left = {c: F.sum(c).over(up) for c in ("w", "s", "cells")}
        whole = {c: F.sum(c).over(by) for c in ("w", "s", "cells")}
        cuts = sums.select(
            "node", "term", "value", F.lead("value").over(by.orderBy("value")).alias("next"),
            *[c.alias(f"l_{k}") for k, c in left.items()], *[c.alias(f"t_{k}") for k, c in whole.items()],
        )
        right_w, right_s = F.col("t_w") - F.col("l_w"), F.col("t_s") - F.col("l_s")
        gain = F.col("l_s") * F.col("l_s") / F.col("l_w") + right_s * right_s / right_w
        # The best gain, then the first term and the lowest cut, as in memory.
        rank = F.when(F.col("next").isNotNull(), F.struct(gain, -F.col("term"), -F.col("value")))
        best = (
            cuts.groupBy("node")
            .agg(
                F.max_by(F.struct("term", "value", "next", "l_cells"), rank).alias("cut"),
                F.max("t_w").alias("w"), F.max("t_s").alias("s"), F.max("t_cells").alias("cells"),
            )
            .collect()  # one row an open node
        )
        later = []
        for r in sorted(best, key=lambda r: r["node"]):
            node, cut = r["node"], r["cut"]
            closed = not 0 < r["s"] < r["w"] or r["w"] <= plan.min_node or top.depth[node] >= plan.max_depth
            if cut is None or closed:
                continue
            middle = float(T.middle(np.array([cut["value"]]), np.array([cut["next"]]))[0])
            top.trees.value[node] = r["s"] / r["w"]
            new = top.split(node, cut["term"], middle)
            counts = (cut["l_cells"], r["cells"] - cut["l_cells"])
            later += [new + side for side in (0, 1) if counts[side] > local]
        state.unpersist()
        open_ = np.array(later, int)


def _message(x, weight, hits, at) -> bytes:
    head = np.array([x.shape[0], x.shape[1], weight.shape[1]], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in (x, weight, hits, np.asarray(at, np.int64)))


def _read(body: bytes):
    rows, terms, trees = np.frombuffer(body, np.int64, 3).tolist()
    start, out = 24, []
    for shape in ((rows, terms), (rows, trees), (rows, trees)):
        out.append(np.frombuffer(body, float, shape[0] * shape[1], start).reshape(shape))
        start += out[-1].nbytes
    return out, np.frombuffer(body, np.int64, -1, start)


def _dealt(plan: _Plan, top, apart: bool):
    """Cells with their draws, to each block of trees, or to each node below the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top.value.trees
        for x, weight, hits in _cells(plan, batches):
            units, bodies = [], []
            if not apart:
                for first in range(0, plan.total, BLOCK):
                    own = slice(first, min(first + BLOCK, plan.total))
                    kept = (weight[:, own] > 0).any(axis=1)
                    units.append(first)
                    bodies.append(_message(x[kept], weight[kept, own], hits[kept, own], range(own.start, own.stop)))
            else:
                for tree in range(plan.total):
                    live = np.flatnonzero(weight[:, tree] > 0)
                    leaf = t.leaves(x[live], np.full(len(live), t.roots[tree]))
                    for node in np.unique(leaf).tolist():
                        mine = live[leaf == node]
                        units.append(node)
                        bodies.append(_message(x[mine], weight[mine, tree, None], hits[mine, tree, None], [node]))
            yield pa.record_batch({"unit": pa.array(units, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return run


def _grown(plan: _Plan, top):
    """Grows the trees under the nodes of each unit, some rows of trees at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top.value
        unit, bodies = None, []
        for batch in batches:
            for u, body in zip(batch.column("unit").to_pylist(), batch.column("body")):
                if u != unit and bodies:
                    yield from _unit(plan, t, bodies)
                    bodies = []
                unit = u
                bodies.append(body.as_py())
        if bodies:
            yield from _unit(plan, t, bodies)

    return run


def _unit(plan: _Plan, top: _Top, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts = [_read(b) for b in bodies]
    x, weight, hits = (np.concatenate(c) for c in zip(*[p for p, _ in parts]))
    nodes = parts[0][1]
    # Rows may come in any order; sums of counts do not depend on it.
    step = max(1, 1_000_000 // max(1, len(x)))
    for first in range(0, len(nodes), step):
        own = nodes[first : first + step]
        spread = [
            np.concatenate(c)
            for c in zip(*[(x, weight[:, first + i], hits[:, first + i], np.full(len(x), i)) for i in range(len(own))])
        ]
        made = T.grow(*spread, top.paths[own], plan.tried, plan.min_node, plan.max_depth, top.depth[own])
        yield pa.record_batch(
            {
                "nodes": pa.array([own.tolist()], pa.list_(pa.int64())),
                "term": pa.array([made.term.tobytes()], pa.binary()),
                "cut": pa.array([made.cut.tobytes()], pa.binary()),
                "left": pa.array([made.left.tobytes()], pa.binary()),
                "value": pa.array([made.value.tobytes()], pa.binary()),
            }
        )


def _grow_rest(coded: DataFrame, plan: _Plan, top: _Top, apart: bool) -> T.Trees:
    """All trees, the top with what grew under its leaves."""
    spark = coded.sparkSession
    state = spark.sparkContext.broadcast(top)
    rows = (
        coded.mapInArrow(_dealt(plan, state, apart), "unit long, body binary")
        .repartition("unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_grown(plan, state), "nodes array<long>, term binary, cut binary, left binary, value binary")
        .collect()
    )
    state.unpersist()
    blocks, nodes = [top.trees], []
    for r in sorted(rows, key=lambda r: r["nodes"][0]):
        blocks.append(
            T.Trees(
                np.frombuffer(r["term"], np.int16), np.frombuffer(r["cut"]), np.frombuffer(r["left"], np.int32),
                np.frombuffer(r["value"]), np.arange(len(r["nodes"])),
            )
        )
        nodes += r["nodes"]
    every = T.Trees.joined(blocks)
    # What grew under a leaf of the top takes its place.
    under, roots = np.array(nodes, int), every.roots[plan.total :]
    for column in (every.term, every.cut, every.left, every.value):
        column[under] = column[roots]
    every.roots = np.arange(plan.total)
    return every
