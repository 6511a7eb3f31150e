"""L1-penalised logistic regression on weighted cells, by active sets.

Coefficients are sparse, so only few columns ever meet in a matrix.  A pass over the
cells gives the gradient of every column as sums by (term, level).  Columns whose
gradient exceeds the penalty join the active set; the problem restricted to that set is
solved by Newton steps, each a quadratic problem solved by coordinate descent on the
cross-products of the active columns alone.  It ends when the optimality conditions hold
for all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.functions.stats import inverse_logit
from areacast.models.design import Design
from areacast.models.gram import accumulate
from areacast.models.linear import INTERCEPT, predictor_from, term_name
from areacast.models.predict import LinearPredictor
from areacast.models.spec import ModelSpec, collapse, report
from areacast.sources.shared import settle

#: Columns that join the active set at once, those of the largest gradients first.
JOINING = 256


@dataclass(frozen=True)
class LassoFit:
    spec: ModelSpec
    design: Design
    penalty: float
    intercept: float
    coefs: np.ndarray
    predictor: LinearPredictor
    cells: DataFrame
    passes: int = 0
    violation: float = 0.0
    converged: bool = True

    def score(self, frame: DataFrame, out: str = "predicted_probability", **kwargs) -> DataFrame:
        return self.predictor.score(frame, out, **kwargs)

    def coefficients(self) -> DataFrame:
        """Table of term, estimate and penalty; terms shrunk to zero are listed."""
        rows = [(INTERCEPT, float(self.intercept), float(self.penalty))]
        rows += [
            (term_name(*self.design.columns[j]), float(self.coefs[j]), float(self.penalty))
            for j in self.design.reading_order()
        ]
        return self.cells.sparkSession.createDataFrame(
            rows, "term string, estimate double, penalty double"
        )


def fit_lasso(df: DataFrame, spec: ModelSpec, penalty: float = 0.01, mixture: float = 1.0, **kwargs) -> LassoFit:
    """Fit from respondents (or weighted rows); reduces them to cells first."""
    return fit_lasso_cells(settle(collapse(df, spec), "cells"), spec, penalty, mixture, **kwargs)


def _deviations(design: Design, cells: DataFrame) -> tuple[float, np.ndarray, dict[str, float]]:
    """Respondents, the deviation of every design column, and the means of the numeric ones.

    Those of dummies follow from the sizes of the levels.
    """
    numeric = [t for t in design.spec.fixed if t not in design.factors]
    n = F.col("_n")
    first = cells.agg(F.sum(n), *[F.sum(n * F.col(t).cast("double")) for t in numeric]).first()
    total = float(first[0] or 0.0)
    if not total:
        raise ValueError("no complete rows to fit")
    mean = {t: first[1 + i] / total for i, t in enumerate(numeric)}
    spread = dict.fromkeys(numeric, 0.0)
    if numeric:
        second = cells.agg(*[F.sum(n * (F.col(t).cast("double") - mean[t]) ** 2) for t in numeric]).first()
        spread = {t: second[i] / total for i, t in enumerate(numeric)}
    sizes = {t: dict(zip(f.levels, f.sizes)) for t, f in design.factors.items()}
    variance = np.empty(len(design.columns))
    for j, (term, level) in enumerate(design.columns):
        if level is None:
            small = 1e-13 * max(mean[term] ** 2, 1e-300)
            variance[j] = spread[term] if spread[term] > small else 0.0
        else:
            share = sizes[term][level] / total
            variance[j] = share * (1 - share)
    return total, np.sqrt(variance), mean


def _gradient(design: Design, cells: DataFrame, predictor: LinearPredictor, mean: dict[str, float]):
    """Sum of residuals, and of residuals times each (centred) column: one aggregation."""
    scored = predictor.score(cells, "_eta", scale="link")
    residual = scored.withColumn("_r", F.col("_s") - F.col("_n") * inverse_logit(F.col("_eta")))
    parts = [F.struct(F.lit("").alias("term"), F.lit("").alias("level"), F.lit(1.0).alias("x"))]
    for t in design.spec.fixed:
        if t in design.factors:
            level, x = F.col(t).cast("string"), F.lit(1.0)
        else:
            level, x = F.lit(""), F.col(t).cast("double") - F.lit(float(mean[t]))
        parts.append(F.struct(F.lit(t).alias("term"), level.alias("level"), x.alias("x")))
    rows = (
        residual.select("_r", F.explode(F.array(*parts)).alias("p"))
        .groupBy("p.term", "p.level")
        .agg(F.sum(F.col("_r") * F.col("p.x")).alias("g"))
        .collect()  # a row a coefficient
    )
    found = {(r["term"], r["level"]): r["g"] for r in rows}
    columns = [(t, "" if v is None else v) for t, v in design.columns]
    return found[("", "")], np.array([found.get(c, 0.0) for c in columns])


def _quadratic(hessian, gradient, at, bound, ridge, tol: float = 1e-13, rounds: int = 10_000):
    """Coordinate descent on a penalised quadratic; the first coordinate is free."""
    x = at.copy()
    slope = gradient + hessian @ (x - at)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            curve = hessian[j, j] + ridge[j]
            if curve <= 0:
                continue
            target = hessian[j, j] * x[j] - slope[j]
            new = np.sign(target) * max(abs(target) - bound[j], 0.0) / curve
            if new != x[j]:
                slope += hessian[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]) * np.sqrt(curve))
                x[j] = new
        if moved < tol:
            break
    return x


def fit_lasso_cells(
    cells: DataFrame, spec: ModelSpec, penalty: float = 0.01, mixture: float = 1.0,
    tol: float = 1e-8, max_passes: int = 200,
) -> LassoFit:
    """Minimise mean log-loss plus ``penalty`` times the elastic-net norm.

    Columns are scaled by their respondent-weighted deviation before the penalty applies,
    and coefficients are scaled back.  ``violation`` is by how much any column misses its
    optimality condition, ``converged`` whether that is below ``tol``.
    """
    if spec.family != "binomial" or spec.random:
        raise ValueError("fit_lasso fits a binomial outcome without random terms")
    design = Design.build(cells, spec)
    total, sd, mean = _deviations(design, cells)
    varies = sd > 0
    unit = np.where(varies, 1.0 / np.where(varies, sd, 1.0), 0.0)
    centre = np.array([mean.get(t, 0.0) if v is None else 0.0 for t, v in design.columns])
    centred = tuple((t, m, 1.0) for t, m in mean.items())
    coded = settle(design.coded(cells), "coded")
    s, n = coded.agg(F.sum("_s"), F.sum("_n")).first()
    share = min(max(s / n, 1e-13), 1 - 1e-13)
    # Coefficients of scaled columns; the intercept is that of centred ones.
    head, beta = float(np.log(share / (1 - share))), np.zeros(len(sd))
    l1, l2 = penalty * mixture, penalty * (1 - mixture)
    active, passes = np.zeros(0, int), 0

    def predictor():
        coefs = beta * unit
        return predictor_from(design, "binomial", head - coefs @ centre, coefs)

    while True:
        first, rest = _gradient(design, cells, predictor(), mean)
        passes += 1
        slope = -rest * unit / total + l2 * beta
        miss = np.where(
            beta != 0, np.abs(slope + l1 * np.sign(beta)), np.maximum(np.abs(slope) - l1, 0.0)
        )
        miss[~varies] = 0.0
        violation = float(max(miss.max(initial=0.0), abs(first) / total))
        if violation <= tol or passes >= max_passes:
            break
        out = np.setdiff1d(np.flatnonzero(miss > tol), active)
        out = out[np.argsort(-miss[out], kind="stable")[:JOINING]]
        active = np.union1d(active[beta[active] != 0], out)
        layout = design.layout().but(keep=tuple(active.tolist()), centre=centred)
        scale = np.append(1.0, unit[active])
        bound, ridge = np.append(0.0, np.full(len(active), l1)), np.append(0.0, np.full(len(active), l2))
        before, last, step = None, None, None
        while passes < max_passes:
            now = np.append(head, beta[active])
            sums = accumulate(coded, layout, "binomial", now * scale)
            passes += 1
            loss = -sums.log_likelihood / total + bound @ np.abs(now) + ridge @ now**2 / 2
            if before is not None and loss > before + 1e-14 * abs(before):
                # Too far: half the step.
                step = step / 2
                now = last + step
                head, beta[active] = float(now[0]), now[1:]
                if np.abs(step).max() < 1e-14:
                    break
                continue
            hessian = sums.cross * np.outer(scale, scale) / total
            new = _quadratic(hessian, -sums.score * scale / total, now, bound, ridge)
            before, last, step = loss, now, new - now
            head, beta[active] = float(new[0]), new[1:]
            # Exact only as far as the other columns' conditions are met.
            if np.abs(step).max() < max(tol * 1e-2, violation * 1e-3):
                break
    coefs = beta * unit
    found = predictor()
    report(violation <= tol, "LASSO", passes)
    return LassoFit(
        spec, design, penalty, float(head - coefs @ centre), coefs, found, cells, passes, violation, violation <= tol
    )
