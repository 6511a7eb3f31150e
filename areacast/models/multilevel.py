"""Multilevel logistic regression: correlated group intercepts and slopes.

The fit maximises the Laplace approximation of the likelihood.  Each outer step
makes one distributed pass that linearises the likelihood at the current
coefficients.  The pass returns cross-products only, so the variance components are
then found on those small matrices, without touching the data.  A handful of passes
is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.functions.stats import Z95
from areacast.models.design import MAX_DENSE, Design, Factor
from areacast.models.gram import Layout, Sums, accumulate
from areacast.models.linear import INTERCEPT, _row, predictor_from, term_name
from areacast.models.predict import LinearPredictor
from areacast.models.spec import ModelSpec, collapse, report
from areacast.sources.shared import settle

# Group blocks (groups x slopes x columns) the driver solves, as many doubles.
MAX_GROUP_ENTRIES = 20_000_000
_TINY = 1e-10


@dataclass(frozen=True)
class MultilevelFit:
    """Fixed coefficients, group effects and their covariance.

    ``covariance`` refers to the intercept and the *standardised* slopes;
    ``effects`` and the predictor are on the original scale.
    """

    spec: ModelSpec
    design: Design
    intercept: float
    coefs: np.ndarray
    kept: tuple[int, ...]
    std_errors: np.ndarray
    group: Factor
    effects: np.ndarray
    covariance: np.ndarray
    deviance: float
    passes: int
    converged: bool
    predictor: LinearPredictor
    cells: DataFrame

    def score(
        self, frame: DataFrame, out: str = "predicted_probability", unseen: str = "error", **kwargs
    ) -> DataFrame:
        return self.predictor.score(frame, out, unseen=unseen, **kwargs)

    def coefficients(self, z: float = Z95) -> DataFrame:
        """Table of the fixed terms with Wald intervals."""
        errors = dict(zip(self.kept, self.std_errors[1:]))
        rows = [_row(INTERCEPT, self.intercept, self.std_errors[0], z)]
        for j in self.design.reading_order():
            name = term_name(*self.design.columns[j])
            if j in errors:
                rows.append(_row(name, self.coefs[j], errors[j], z))
            else:
                rows.append((name, None, None, None, None))
        return self.cells.sparkSession.createDataFrame(
            rows,
            "term string, estimate double, std_error double, conf_low double, conf_high double",
        )

    def group_effects(self) -> DataFrame:
        """Table of group level, term and effect."""
        names = [INTERCEPT, *self.spec.random[0][1]]
        rows = [
            (level, name, float(self.effects[j, k]))
            for j, level in enumerate(self.group.levels)
            for k, name in enumerate(names)
        ]
        return self.cells.sparkSession.createDataFrame(
            rows, f"`{self.spec.random[0][0]}` string, term string, effect double"
        )


def _invert(m: np.ndarray) -> np.ndarray:
    """Inverse of a covariance matrix, kept away from singular."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors / np.maximum(values, _TINY)) @ vectors.T


def _solve(sums: Sums, rhs_fixed, rhs_group, precision):
    """Coefficients and effects of the penalised normal equations.

    Groups are eliminated first (their blocks are independent), which leaves a
    system of the size of the fixed part.
    """
    inverse = np.linalg.inv(sums.group_cross + precision)
    fi = sums.group_fixed @ inverse
    schur = sums.cross - np.einsum("jpq,jrq->pr", fi, sums.group_fixed)
    rhs = rhs_fixed - np.einsum("jpq,jq->p", fi, rhs_group)
    beta = np.linalg.solve(schur, rhs)
    residual = rhs_group - np.einsum("jpq,p->jq", sums.group_fixed, beta)
    return beta, np.einsum("jab,jb->ja", inverse, residual), inverse, schur


def _variance_steps(sums, rhs_fixed, rhs_group, sigma, fixed, steps, tol):
    """Solve the linearised model, updating the covariance unless it is given.

    Expectation-maximisation with parameter expansion (Liu, Rubin and Wu, 1998):
    a working matrix rescales the effects at each step, which keeps convergence
    fast when a variance is close to zero.
    """
    q = sigma.shape[0]
    for _ in range(1 if fixed else steps):
        beta, effects, inverse, schur = _solve(sums, rhs_fixed, rhs_group, _invert(sigma))
        if fixed:
            break
        second = np.einsum("ja,jb->jab", effects, effects) + inverse
        residual = rhs_group - np.einsum("jpq,p->jq", sums.group_fixed, beta)
        normal = np.einsum("jac,jdb->abcd", sums.group_cross, second).reshape(q * q, q * q)
        target = np.einsum("ja,jb->ab", residual, effects).ravel()
        expand = np.linalg.lstsq(normal, target, rcond=1e-14)[0].reshape(q, q)
        updated = expand @ second.mean(axis=0) @ expand.T
        change = np.max(np.abs(updated - sigma)) / max(np.max(np.abs(updated)), 1e-6)
        sigma = updated
        if change < tol:
            break
    return beta, effects, sigma, schur


def _tilted(sums, rhs_fixed, rhs_group, root):
    """Solve at covariance ``root @ root.T`` with the Laplace term linearised.

    The log-determinant depends on the coefficients through the working weights;
    the tilts are its gradient.  Also returns the gradient along ``root``, in a
    form that holds for a singular covariance.
    """
    sigma = root @ root.T
    q = len(sigma)
    shrink = np.linalg.inv(np.eye(q) + sigma @ sums.group_cross)
    spread = shrink @ sigma
    fi = sums.group_fixed @ spread
    schur = sums.cross - np.einsum("jpq,jrq->pr", fi, sums.group_fixed)
    tilt = sums.tilt - np.einsum("jpq,jq->p", fi, sums.group_tilt)
    rhs = rhs_fixed - np.einsum("jpq,jq->p", fi, rhs_group) - 0.5 * tilt
    beta = np.linalg.solve(schur, rhs)
    residual = rhs_group - np.einsum("jpq,p->jq", sums.group_fixed, beta)
    effects = np.einsum("jab,jb->ja", spread, residual)
    a = np.einsum("jba,jb->ja", shrink, residual)
    t = np.einsum("jba,jb->ja", shrink, sums.group_tilt)
    slope = np.einsum("ja,jb->ab", a, a - t) - np.einsum("jab,jbc->ac", sums.group_cross, shrink)
    gradient = np.tril((slope + slope.T) / 2 @ root)[np.tril_indices(q)]
    return beta, effects, spread, schur, gradient


def _laplace_step(sums, rhs_fixed, rhs_group, sigma, steps: int = 25):
    """Newton steps along the covariance root to the optimum with the tilts.

    Returns nothing if they lead far away from where they start.
    """
    q = len(sigma)
    lower = np.tril_indices(q)
    start = np.linalg.cholesky(sigma + _TINY * np.eye(q))
    size = max(np.abs(start).max(), 1e-4)

    def solve(values):
        root = np.zeros((q, q))
        root[lower] = values
        return _tilted(sums, rhs_fixed, rhs_group, root)

    x = start[lower]
    for _ in range(steps):
        gradient = solve(x)[-1]
        h = 1e-5 * size
        jacobian = np.column_stack(
            [(solve(x + h * e)[-1] - solve(x - h * e)[-1]) / (2 * h) for e in np.eye(len(x))]
        )
        move = -np.linalg.lstsq(jacobian, gradient, rcond=1e-12)[0]
        x = x + move
        if not np.isfinite(x).all() or np.abs(x - start[lower]).max() > 0.5 * size:
            return None
        if np.abs(move).max() < 1e-10 * size:
            break
    root = np.zeros((q, q))
    root[lower] = x
    beta, effects, spread, schur, _ = solve(x)
    return beta, effects, root @ root.T, spread, schur


def _estimate(sums, rhs_fixed, rhs_group, sigma, steps):
    """Coefficients, effects and covariance of one linearisation.

    Expectation-maximisation gets close, Newton steps finish.  Should they stray,
    expectation-maximisation goes on to the end before they are tried again.
    """
    for tolerance in (1e-3, 1e-9):
        beta, effects, sigma, schur = _variance_steps(
            sums, rhs_fixed, rhs_group, sigma, False, steps, tolerance
        )
        found = _laplace_step(sums, rhs_fixed, rhs_group, sigma)
        if found is not None:
            return found
    spread = np.linalg.inv(sums.group_cross + _invert(sigma))
    return beta, effects, sigma, spread, schur


def _laplace_deviance(sums: Sums, effects, sigma) -> float:
    precision = _invert(sigma)
    q = sigma.shape[0]
    penalty = float(np.einsum("ja,ab,jb->", effects, precision, effects))
    _, logdet = np.linalg.slogdet(np.eye(q) + sigma @ sums.group_cross)
    return -2.0 * sums.log_likelihood + penalty + float(logdet.sum())


def fit_multilevel(df: DataFrame, spec: ModelSpec, **kwargs) -> MultilevelFit:
    """Fit from respondents (or weighted rows); reduces them to cells first."""
    return fit_multilevel_cells(settle(collapse(df, spec), "cells"), spec, **kwargs)


def fit_multilevel_cells(
    cells: DataFrame, spec: ModelSpec, covariance=None, max_passes: int = 40, tol: float = 1e-7,
    variance_steps: int = 1000,
) -> MultilevelFit:
    """Laplace fit of coefficients and effect covariance.

    With a given ``covariance`` it is the penalised likelihood fit at that value.  Warns
    (``NotConverged``) if estimates still move by ``tol`` after ``max_passes``.
    """
    if spec.family != "binomial":
        raise ValueError("fit_multilevel fits a binomial outcome")
    if len(spec.random) != 1:
        raise ValueError("fit_multilevel takes exactly one grouping term")
    group_name, slopes = spec.random[0]
    design = Design.build(cells, spec, also=[group_name])
    group = design.factors[group_name]
    groups, q = len(group.levels), 1 + len(slopes)
    if len(design.columns) > MAX_DENSE or groups * q * (len(design.columns) + q) > MAX_GROUP_ENTRIES:
        raise ValueError("too many coefficients for the normal equations")
    coded = design.coded(cells).persist()
    moments = design.moments(coded)
    kept = moments.kept
    slope_stats = _slope_moments(cells, slopes)
    # Standardising the numeric terms leaves the model as it is and steadies the algebra.
    numeric = np.array([design.columns[j][1] is None for j in kept], dtype=bool)
    shift = np.where(numeric, moments.mean[list(kept)], 0.0)
    scale = np.where(numeric, moments.sd[list(kept)], 1.0)
    layout: Layout = design.layout().but(
        keep=kept,
        centre=tuple(
            (design.columns[j][0], m, s) for j, m, s in zip(kept, shift, scale) if design.columns[j][1] is None
        ),
        group=design.index_column(group_name),
        slopes=slopes,
        slope_shift=tuple(m for m, _ in slope_stats),
        slope_scale=tuple(s for _, s in slope_stats),
    )
    given = covariance is not None
    sigma = np.atleast_2d(np.asarray(covariance, dtype=float)) if given else np.eye(q) * 0.25
    beta, effects = np.zeros(layout.width), np.zeros((groups, q))
    spread = np.zeros((groups, q, q))
    converged = False
    for step in range(1, max_passes + 1):
        sums = accumulate(coded, layout, "binomial", beta, effects, spread)
        rhs_fixed = sums.cross @ beta + np.einsum("jpq,jq->p", sums.group_fixed, effects) + sums.score
        rhs_group = (
            np.einsum("jpq,p->jq", sums.group_fixed, beta)
            + np.einsum("jab,jb->ja", sums.group_cross, effects)
            + sums.group_score
        )
        if given:
            new_beta, new_effects, sigma, schur = _variance_steps(
                sums, rhs_fixed, rhs_group, sigma, True, 1, 0.0
            )
        else:
            new_beta, new_effects, sigma, spread, schur = _estimate(
                sums, rhs_fixed, rhs_group, sigma, variance_steps
            )
        change = max(np.max(np.abs(new_beta - beta)), np.max(np.abs(new_effects - effects)))
        beta, effects = new_beta, new_effects
        if change < tol:
            converged = True
            break
    final = accumulate(coded, layout, "binomial", beta, effects, spread)
    coded.unpersist()
    report(converged, "multilevel model", step)
    return _finish(spec, design, cells, kept, shift, scale, slope_stats, group, final,
                   schur, beta, effects, sigma, step + 1, converged)


def _slope_moments(cells: DataFrame, slopes) -> list[tuple[float, float]]:
    """Weighted mean and deviation per slope variable; only used to scale."""
    if not slopes:
        return []
    n = F.col("_n")
    row = cells.agg(
        F.sum(n),
        *[F.sum(n * F.col(c).cast("double")) for c in slopes],
        *[F.sum(n * F.col(c).cast("double") ** 2) for c in slopes],
    ).first()
    out = []
    for k in range(len(slopes)):
        mean = row[1 + k] / row[0]
        variance = row[1 + len(slopes) + k] / row[0] - mean**2
        out.append((mean, float(np.sqrt(variance)) if variance > 1e-12 * max(mean**2, 1e-12) else 1.0))
    return out


def _finish(spec, design, cells, kept, shift, scale, slope_stats, group, sums, schur, beta,
            effects, sigma, passes, converged) -> MultilevelFit:
    """Undo the scaling and build the scorer."""
    coefs = np.zeros(len(design.columns))
    coefs[list(kept)] = beta[1:] / scale
    intercept = float(beta[0] - np.sum(beta[1:] * shift / scale))
    undo = np.eye(len(beta))
    undo[0, 1:] = -shift / scale
    undo[1:, 1:] = np.diag(1.0 / scale)
    covariance = undo @ np.linalg.pinv(schur) @ undo.T
    # Level numbers run from the last level to the first.
    raw = effects[::-1].copy()
    for k, (m, s) in enumerate(slope_stats, start=1):
        raw[:, k] /= s
        raw[:, 0] -= raw[:, k] * m
    name, slopes = spec.random[0]
    tables = {
        slope: {level: float(raw[j, k]) for j, level in enumerate(group.levels)}
        for k, slope in enumerate(["", *slopes])
    }
    base = predictor_from(design, "binomial", intercept, coefs)
    predictor = LinearPredictor("binomial", intercept, base.numeric, base.factors, {name: tables})
    return MultilevelFit(
        spec, design, intercept, coefs, tuple(kept),
        np.sqrt(np.maximum(np.diag(covariance), 0.0)), group, raw, sigma,
        _laplace_deviance(sums, effects, sigma), passes, converged, predictor, cells,
    )
