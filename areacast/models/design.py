"""Dummy coding of the fixed terms, and removal of aliased columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.models.crossed import independent_of_two
from areacast.models.gram import Layout, accumulate
from areacast.models.spec import ModelSpec, is_factor
from areacast.operators.joins import lookup_join

# Levels become coefficients held by the driver, so their number must be modest.
MAX_LEVELS = 1_000_000
# Normal equations are solved up to this many columns.
MAX_DENSE = 4096
ALIAS_TOLERANCE = 1e-8
# A second factor with more levels gets no matrix over them either; results are the same.
DENSE_SECOND = 512
# Up to this many levels are numbered by a model in the plan, more by a joined table.
INLINE_CODES = 1_000


@dataclass(frozen=True)
class Factor:
    """A text term.  ``levels`` are in order, the first is the baseline.

    A declared level without rows keeps its place, with a coefficient of zero.
    """

    name: str
    levels: tuple[str, ...]
    sizes: tuple[float, ...]


def factor_levels(cells: DataFrame, names: Sequence[str], spec: ModelSpec) -> dict[str, Factor]:
    """Levels of several text columns with their weights, in one job."""
    if not names:
        return {}
    pairs = [
        F.struct(F.lit(c).alias("term"), F.col(c).cast("string").alias("level")) for c in names
    ]
    counted = (
        cells.select("_n", F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.term", "p.level")
        .agg(F.sum("_n").alias("n"))
    )
    rows = counted.limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} factor levels")
    found: dict[str, dict[str, float]] = {c: {} for c in names}
    for r in rows:
        found[r["term"]][r["level"]] = float(r["n"])
    out = {}
    for c in names:
        levels = sorted(found[c])
        if c in spec.levels:
            declared = [str(v) for v in spec.levels[c]]
            unknown = set(levels) - set(declared)
            if unknown:
                raise ValueError(f"undeclared levels of {c}: {sorted(unknown)}")
            levels = declared
        out[c] = Factor(c, tuple(levels), tuple(found[c].get(v, 0.0) for v in levels))
    return out


@dataclass(frozen=True)
class Moments:
    """Per design column: weighted mean, deviation, and which columns are independent.

    An aliased column is a linear combination of the intercept and the columns
    before it in reading order; it is left out of a fit.
    """

    total: float
    mean: np.ndarray
    sd: np.ndarray
    kept: tuple[int, ...]


def _independent(corr: np.ndarray, order: list[int]) -> list[int]:
    """Columns, taken in order, that are not a combination of those before them."""
    try:
        pivots = np.diag(np.linalg.cholesky(corr[np.ix_(order, order)])) ** 2
        if (pivots >= ALIAS_TOLERANCE).all():
            return order
    except np.linalg.LinAlgError:
        pass
    kept = []
    for j in order:
        pivot = corr[j, j]
        if pivot >= ALIAS_TOLERANCE:
            kept.append(j)
            corr = corr - np.outer(corr[:, j], corr[j, :]) / pivot
    return kept


@dataclass(frozen=True)
class Design:
    """Coding of the fixed terms.

    ``columns`` lists (term, level) per design column in vector order; the level
    is ``None`` for a numeric term.
    """

    spec: ModelSpec
    factors: dict[str, Factor]
    columns: tuple[tuple[str, str | None], ...]

    @classmethod
    def build(cls, cells: DataFrame, spec: ModelSpec, also: Sequence[str] = ()) -> Design:
        """Read the levels off the training cells; ``also`` adds grouping columns."""
        texts = [c for c in spec.fixed if is_factor(cells.schema, c, spec)]
        wanted = list(dict.fromkeys([*texts, *also]))
        factors = factor_levels(cells, wanted, spec)
        columns: list[tuple[str, str | None]] = []
        for term in spec.fixed:
            if term in texts:
                columns += [(term, v) for v in reversed(factors[term].levels[1:])]
            else:
                columns.append((term, None))
        return cls(spec, factors, tuple(columns))

    def index_column(self, term: str) -> str:
        return f"_i_{term}"

    def coded(self, df: DataFrame) -> DataFrame:
        """Add a level number per factor: last level 0, baseline highest."""
        for term, factor in self.factors.items():
            if len(factor.levels) > INLINE_CODES:
                df = self._looked_up(df, term, factor)
                continue
            model = StringIndexerModel.from_labels(
                list(reversed(factor.levels)), f"_t_{term}", self.index_column(term), "error"
            )
            df = model.transform(df.withColumn(f"_t_{term}", F.col(term).cast("string")))
            df = df.drop(f"_t_{term}")
        return df

    def _looked_up(self, df: DataFrame, term: str, factor: Factor) -> DataFrame:
        key, number = f"_t_{term}", self.index_column(term)
        rows = [(level, float(i)) for i, level in enumerate(reversed(factor.levels))]
        table = df.sparkSession.createDataFrame(rows, f"`{key}` string, `{number}` double")
        df = lookup_join(df.withColumn(key, F.col(term).cast("string")), table, key)
        unseen = F.raise_error(F.concat(F.lit(f"Unseen label of {term}: "), F.coalesce(key, F.lit("null"))))
        return df.withColumn(number, F.coalesce(number, unseen.cast("double"))).drop(key)

    def vectors(self, cells: DataFrame) -> DataFrame:
        """Cells with a ``features`` vector in the order of ``columns``."""
        df = self.coded(cells)
        inputs = []
        coded = [
            t for t in self.spec.fixed if t in self.factors and len(self.factors[t].levels) > 1
        ]
        if coded:
            encoder = OneHotEncoder(
                inputCols=[self.index_column(t) for t in coded],
                outputCols=[f"_v_{t}" for t in coded],
                dropLast=True,
            )
            df = encoder.fit(df).transform(df)
        for t in self.spec.fixed:
            if t in coded:
                inputs.append(f"_v_{t}")
            elif t not in self.factors:
                df = df.withColumn(f"_v_{t}", F.col(t).cast("double"))
                inputs.append(f"_v_{t}")
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(df)

    def reading_order(self) -> list[int]:
        """Column positions by term, then level in declared order."""
        rank = {t: i for i, t in enumerate(self.spec.fixed)}
        place = {
            (t, v): i for t in rank if t in self.factors
            for i, v in enumerate(self.factors[t].levels)
        }
        return sorted(
            range(len(self.columns)),
            key=lambda k: (rank[self.columns[k][0]], place.get(self.columns[k], 0)),
        )

    def layout(self) -> Layout:
        """The same coding for passes that build dense rows inside tasks."""
        terms = []
        for t in self.spec.fixed:
            if t in self.factors:
                width = len(self.factors[t].levels) - 1
                terms.append((self.index_column(t), width if width else -1))
            else:
                terms.append((t, 0))
        return Layout(tuple(terms))

    def moments(self, coded: DataFrame) -> Moments:
        """Weighted means, deviations and independent columns, from one pass."""
        p = len(self.columns)
        sums = accumulate(coded, self.layout())
        m = sums.cross
        total = m[0, 0]
        mean = m[0, 1:] / total
        norm = np.diag(m)[1:] / total
        variance = norm - mean**2
        varies = variance > 1e-13 * np.maximum(norm, 1e-300)
        sd = np.sqrt(np.where(varies, variance, 0.0))
        unit = np.where(varies, sd, 1.0)
        corr = (m[1:, 1:] / total - np.outer(mean, mean)) / np.outer(unit, unit)
        kept = _independent(corr, [j for j in self.reading_order() if varies[j]])
        return Moments(total, mean, sd, tuple(sorted(kept)))

    def independent(self, coded: DataFrame) -> tuple[int, ...]:
        """The independent columns of ``moments`` without a matrix over the longest
        factor's levels: sums by level, and cross-products of the other columns alone.
        A second long factor is left out of that matrix too (see ``crossed``).
        """
        texts = [t for t in self.spec.fixed if t in self.factors]
        texts = sorted(texts, key=lambda t: -len(self.factors[t].levels))
        if not texts or len(self.factors[texts[0]].levels) < 2:
            return self.moments(coded).kept
        longest = texts[0]
        if len(texts) > 1 and len(self.factors[texts[1]].levels) > DENSE_SECOND:
            first, second = sorted(texts[:2], key=self.spec.fixed.index)
            return independent_of_two(self, coded, first, second, ALIAS_TOLERANCE)
        levels, number = len(self.factors[longest].levels), self.index_column(longest)
        numeric = [t for t in self.spec.fixed if t not in self.factors]
        sums = [F.sum(F.col("_n") * F.col(t).cast("double")) / F.sum("_n") for t in numeric]
        centre = dict(zip(numeric, coded.agg(*sums).first())) if numeric else {}
        layout = Layout(
            tuple(t for t in self.layout().terms if t[0] != number),
            centre=tuple((t, m, 1.0) for t, m in centre.items()), group=number,
        )
        nothing = np.zeros((levels, 1))
        found = accumulate(
            coded, layout, "gaussian", np.zeros(layout.width), nothing, nothing[:, :, None]
        )
        m, n = found.cross, found.group_cross[:, 0, 0]
        others = [j for j, (t, _) in enumerate(self.columns) if t != longest]
        total, mean = m[0, 0], m[0, 1:] / m[0, 0]
        variance = np.diag(m)[1:] / total - mean**2
        middle = np.array([centre.get(self.columns[j][0], 0.0) for j in others])
        varies = variance > 1e-13 * np.maximum(np.diag(m)[1:] / total + middle**2, 1e-300)
        unit = np.where(varies, np.sqrt(np.where(varies, variance, 1.0)), 1.0)
        corr = (m[1:, 1:] / total - np.outer(mean, mean)) / np.outer(unit, unit)
        there = np.flatnonzero(n > 0)
        inside = (found.group_fixed[there, 1:, 0] / n[there, None] - mean) / unit
        within = corr - (inside * (n[there, None] / total)).T @ inside
        place = {j: i for i, j in enumerate(others)}
        order = [j for j in self.reading_order() if j in place and varies[place[j]]]
        rank = {t: i for i, t in enumerate(self.spec.fixed)}
        early = [place[j] for j in order if rank[self.columns[j][0]] < rank[longest]]
        late = [place[j] for j in order if rank[self.columns[j][0]] > rank[longest]]
        early = _independent(corr, early)
        # Combinations of earlier columns that are constant within levels alias as many dummies.
        root = np.linalg.cholesky(corr[np.ix_(early, early)])
        white = np.linalg.solve(root, np.linalg.solve(root, within[np.ix_(early, early)]).T)
        share, ways = np.linalg.eigh((white + white.T) / 2)
        constant = np.linalg.solve(root.T, ways[:, share < ALIAS_TOLERANCE])
        values = np.hstack([np.ones((len(there), 1)), inside[:, early] @ constant])
        aliased = _pivot_rows(values, there, levels - 1)
        start = self.columns.index((longest, self.factors[longest].levels[-1]))
        dummies = [start + g for g in there.tolist() if g < levels - 1 and g not in aliased]
        kept = {*early, *_independent(within, [*early, *late])}
        return tuple(sorted([*dummies, *(others[i] for i in kept)]))


def _pivot_rows(values: np.ndarray, levels: np.ndarray, baseline: int) -> set[int]:
    """Levels whose rows raise the rank, the baseline read first and then from the last
    declared level (number 0) on."""
    place = {g: i for i, g in enumerate(levels.tolist())}
    basis, found = np.zeros((0, values.shape[1])), set()
    for g in [baseline, *range(baseline)]:
        if g not in place:
            continue
        row = values[place[g]]
        left = row - basis.T @ (basis @ row)
        left = left - basis.T @ (basis @ left)
        size = np.linalg.norm(left)
        if size > 1e-8 * np.linalg.norm(row):
            basis = np.vstack([basis, left / size])
            found.add(g)
            if len(basis) == values.shape[1]:
                break
    return found
