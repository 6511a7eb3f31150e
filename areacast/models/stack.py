"""Stacked ensemble: members weighted by cross-validated performance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.functions.stats import fold_of
from areacast.models.design import factor_levels
from areacast.models.forest import fit_forest_cells, fit_forests
from areacast.models.linear import fit_linear_cells
from areacast.models.spec import ModelSpec, collapse, is_factor
from areacast.operators.joins import as_list
from areacast.sources.shared import settle


class Fitted(Protocol):
    def score(self, frame: DataFrame, out: str) -> DataFrame: ...


Learner = Callable[[DataFrame, ModelSpec], Fitted]


@dataclass(frozen=True)
class ForestLearner:
    """Forests of all folds are grown together."""

    options: Mapping

    def __call__(self, cells: DataFrame, spec: ModelSpec) -> Fitted:
        return fit_forest_cells(cells, spec, **self.options)

    def fit_sets(self, cells: DataFrame, spec: ModelSpec, names: Sequence) -> dict[object, Fitted]:
        return fit_forests(cells, spec, names, **self.options)


def forest_learner(**kwargs) -> Learner:
    return ForestLearner(kwargs)


def linear_learner() -> Learner:
    return fit_linear_cells


def nonnegative_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Non-negative least squares from an m x m Gram matrix, scaled to sum to 1.

    The best member set is searched directly: m is the number of learners.
    """
    m = len(cross)
    best, best_loss = np.zeros(m), 0.0
    for mask in range(1, 1 << m):
        s = [k for k in range(m) if mask >> k & 1]
        w, *_ = np.linalg.lstsq(gram[np.ix_(s, s)], cross[s], rcond=None)
        if (w < 0).any():
            continue
        loss = w @ gram[np.ix_(s, s)] @ w - 2 * w @ cross[s]
        if loss < best_loss - 1e-15:
            best, best_loss = np.zeros(m), loss
            best[s] = w
    total = best.sum()
    return best / total if total > 0 else np.full(m, 1.0 / m)


@dataclass(frozen=True)
class StackedFit:
    """``weights`` are non-negative and sum to 1; ``risk`` is the out-of-fold squared error."""

    spec: ModelSpec
    members: Mapping[str, Fitted]
    weights: Mapping[str, float]
    risk: Mapping[str, float]
    cells: DataFrame

    def score(self, frame: DataFrame, out: str = "predicted_probability") -> DataFrame:
        """Weighted sum of the member scores; members of weight 0 are not run."""
        total = F.lit(0.0)
        names = []
        for k, (name, weight) in enumerate(self.weights.items()):
            if weight == 0.0:
                continue
            names.append(f"_m_{k}")
            frame = self.members[name].score(frame, names[-1])
            total = total + F.lit(float(weight)) * F.col(names[-1])
        return frame.withColumn(out, total).drop(*names)

    def member_table(self) -> DataFrame:
        rows = [(k, float(w), float(self.risk[k])) for k, w in self.weights.items()]
        return self.cells.sparkSession.createDataFrame(
            rows, "learner string, weight double, cv_risk double"
        )


def fit_stack(
    df: DataFrame, spec: ModelSpec, learners: Mapping[str, Learner], id=None, folds: int = 10,
    seed: int = 42, parallelism: int = 4, fold: str | None = None,
) -> StackedFit:
    """Cross-validate the learners, weight them, and refit each on everything.

    Folds are drawn by respondent, before the rows are reduced to cells; a fold
    is then just one more key of the cell table.  Cells that carry their fold
    already name its column with ``fold``.
    """
    if (id is None) == (fold is None):
        raise ValueError("give either the respondent id or a fold column")
    number = F.col(fold) if fold else fold_of(as_list(id), folds, seed)
    by_fold = collapse(df.withColumn("_fold", number), spec, extra=["_fold"])
    return fit_stack_cells(by_fold, spec, learners, folds, parallelism)


SUMS = ("_n", "_s", "_q")
# A share of a cell's weight that is left when a fold is taken out is rounding below this.
ROUNDING = 1e-9


def fold_table(by_fold: DataFrame, keys: Sequence[str], folds: int, fold: str = "_fold") -> DataFrame:
    """One row a cell: its sums, and arrays of them by fold."""

    def of(c, k):
        return F.coalesce(F.sum(F.when(F.col(fold) == k, F.col(c))), F.lit(0.0))

    return by_fold.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.array(*[of(c, k) for k in range(folds)]).alias(f"{c}_by_fold") for c in SUMS],
    )


def fit_stack_cells(
    by_fold: DataFrame, spec: ModelSpec, learners: Mapping[str, Learner], folds: int,
    parallelism: int = 4, fold: str = "_fold",
) -> StackedFit:
    """The same from cells that carry a fold number.

    One table is written, of cells with their sums by fold.  What a fold is trained on
    are the sums of the whole minus its own, so no fold needs a table or a shuffle.
    """
    names = list(learners)
    keys = spec.columns
    table = settle(fold_table(by_fold, keys, folds, fold), "fold_cells")
    everything = table.select(*keys, *SUMS)
    # Declare all levels, so that one missing from a training fold can be scored.
    texts = [c for c in spec.fixed if is_factor(everything.schema, c, spec)]
    levels = {c: f.levels for c, f in factor_levels(everything, texts, spec).items()}
    spec = spec.but(levels=levels)

    def left(c, k):
        rest = F.col(c) - F.col(f"{c}_by_fold")[k]
        return F.when(F.col("_n") - F.col("_n_by_fold")[k] > ROUNDING * F.col("_n"), rest).otherwise(0.0)

    def training(k):
        if k is None:
            return everything
        return table.select(*keys, *[left(c, k).alias(c) for c in SUMS]).filter(F.col("_n") > 0)

    sets = [None, *range(folds)]
    together = [name for name in names if hasattr(learners[name], "fit_sets")]
    jobs = [(k, name) for k in sets for name in names if name not in together]
    # Independent fits are submitted side by side, as in Spark's own cross-validator.
    with ThreadPoolExecutor(parallelism) as pool:
        inherit = inheritable_thread_target(by_fold.sparkSession)

        def run_sets(name):
            all_sets = table.select(
                *keys, "_n",
                *[
                    F.array(*[F.col(c) if k is None else left(c, k) for k in sets]).alias(f"{c}f")
                    for c in ("_n", "_s")
                ],
            )
            return learners[name].fit_sets(all_sets, spec, sets)

        def run(job):
            k, name = job
            return learners[name](training(k), spec)

        grouped = {name: pool.submit(inherit(run_sets), name) for name in together}
        fitted = dict(zip(jobs, pool.map(inherit(run), jobs)))
        for name, future in grouped.items():
            fitted |= {(k, name): fit for k, fit in future.result().items()}

    def held_out(k):
        part = table.select(*keys, *[F.col(f"{c}_by_fold")[k].alias(c) for c in SUMS]).filter(F.col("_n") > 0)
        for i, name in enumerate(names):
            part = fitted[(k, name)].score(part, f"_z{i}")
        return part.select("_n", "_s", "_q", *[f"_z{i}" for i in range(len(names))])

    scored = reduce(DataFrame.unionByName, [held_out(k) for k in range(folds)])
    z = [F.col(f"_z{i}") for i in range(len(names))]
    m = len(names)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = scored.agg(
        *[F.sum(F.col("_n") * z[i] * z[j]) for i, j in pairs],
        *[F.sum(F.col("_s") * z[i]) for i in range(m)],
        F.sum("_q"),
        F.sum("_n"),
    ).first()
    gram = np.zeros((m, m))
    for (i, j), v in zip(pairs, row):
        gram[i, j] = gram[j, i] = v
    cross = np.array(row[len(pairs) : len(pairs) + m], dtype=float)
    squares, total = row[-2], row[-1]
    weights = nonnegative_weights(gram, cross)
    risk = (squares - 2 * cross + np.diag(gram)) / total
    return StackedFit(
        spec,
        {name: fitted[(None, name)] for name in names},
        dict(zip(names, map(float, weights))),
        dict(zip(names, map(float, risk))),
        everything,
    )
