"""Regression with one long factor, whose levels are eliminated instead of solved for.

Given the other coefficients, each level's effect follows from its own sums, so a Newton
step needs a dense matrix over the other columns alone (the Schur complement) and a few
numbers per level.  Every level has an effect while fitting; the coding by a baseline, and
by earlier columns that are constant within levels, is put back at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.models.design import Design, _independent
from areacast.models.gram import Layout, Sums, accumulate
from areacast.models.spec import report


def longest_factor(design: Design) -> str | None:
    texts = [t for t in design.spec.fixed if t in design.factors]
    return max(texts, key=lambda t: len(design.factors[t].levels), default=None)


@dataclass(frozen=True)
class _Coding:
    """How the kept columns follow from the columns inside levels and the level effects.

    ``inside`` and ``constant`` are positions among the other columns: those that vary
    within levels, and earlier ones that do not beyond what ``inside`` explains
    (``explained``).  ``anchors`` are the levels without a dummy: as many as there are
    constant columns, and one for the intercept.
    """

    others: tuple[int, ...]
    inside: tuple[int, ...]
    constant: tuple[int, ...]
    explained: np.ndarray
    rest: np.ndarray
    anchors: np.ndarray
    solve: np.ndarray
    dummies: np.ndarray
    start: int
    middle: np.ndarray


@dataclass(frozen=True)
class LongFit:
    """Newton fit: ``beta`` of the columns inside levels, ``effects`` of all levels."""

    design: Design
    kept: tuple[int, ...]
    coding: _Coding
    layout: Layout
    beta: np.ndarray
    effects: np.ndarray
    passes: int
    converged: bool

    def coefficients(self) -> tuple[float, np.ndarray]:
        """Intercept and all design columns, zero for what is aliased."""
        c = self.coding
        first = c.solve @ self.effects[c.anchors]
        outer = first[1:]
        coefs = np.zeros(len(self.design.columns))
        coefs[[c.others[i] for i in c.inside]] = self.beta - c.explained @ outer
        coefs[[c.others[i] for i in c.constant]] = outer
        coefs[c.start + c.dummies] = self.effects[c.dummies] - first[0] - c.rest[c.dummies] @ outer
        return float(first[0] - coefs[list(c.others)] @ c.middle), coefs

    def standard_errors(self, coded: DataFrame) -> np.ndarray:
        """Intercept first, then the kept columns, from one pass over the cells."""
        c, family = self.coding, self.design.spec.family
        sums = _sums(coded, self.layout, family, self.beta, self.effects)
        cross, own, mixed = sums.cross[1:, 1:], sums.group_cross[:, 0, 0], sums.group_fixed[:, 1:, 0]
        weight = np.where(own > 0, own, 1.0)
        mean = mixed / weight[:, None]
        inner = np.linalg.inv(cross - mean.T @ mixed) if len(cross) else cross
        spread = 1.0 / weight
        at = c.anchors

        def variance(on_beta: np.ndarray, on_anchors: np.ndarray) -> np.ndarray:
            """Of combinations (rows) of ``beta`` and the anchors' effects."""
            left = on_beta - on_anchors @ mean[at]
            return on_anchors**2 @ spread[at] + np.einsum("ij,jk,ik->i", left, inner, left)

        k = len(c.inside)
        outer_anchor, outer_beta = c.solve[1:], np.zeros((len(c.constant), k))
        inside_anchor, inside_beta = -c.explained @ c.solve[1:], np.eye(k)
        by_other = {i: (inside_beta[n], inside_anchor[n]) for n, i in enumerate(c.inside)}
        by_other |= {i: (outer_beta[n], outer_anchor[n]) for n, i in enumerate(c.constant)}
        head_beta, head_anchor = np.zeros(k), c.solve[0].copy()
        for i, (b, a) in by_other.items():
            head_beta, head_anchor = head_beta - c.middle[i] * b, head_anchor - c.middle[i] * a
        out = np.full(len(self.design.columns), np.nan)
        for i, (b, a) in by_other.items():
            out[c.others[i]] = variance(b[None], a[None])[0]
        on = np.hstack([np.ones((len(c.dummies), 1)), c.rest[c.dummies]]) @ c.solve
        left = on @ mean[at] - mean[c.dummies]
        out[c.start + c.dummies] = (
            spread[c.dummies] + on**2 @ spread[at] + np.einsum("ij,jk,ik->i", left, inner, left)
        )
        head = variance(head_beta[None], head_anchor[None])[0]
        return np.sqrt(np.append(head, out[list(self.kept)]))


def _sums(coded: DataFrame, layout: Layout, family: str, beta, effects) -> Sums:
    none = np.zeros((len(effects), 1, 1))
    return accumulate(coded, layout, family, np.append(0.0, beta), effects[:, None], none)


def _coding(design: Design, coded: DataFrame, kept: tuple[int, ...], longest: str) -> tuple[_Coding, Layout]:
    number = design.index_column(longest)
    levels = len(design.factors[longest].levels)
    others = tuple(j for j, (t, _) in enumerate(design.columns) if t != longest)
    numeric = [t for t in design.spec.fixed if t not in design.factors]
    sums = [F.sum(F.col("_n") * F.col(t).cast("double")) / F.sum("_n") for t in numeric]
    centre = dict(zip(numeric, coded.agg(*sums).first())) if numeric else {}
    layout = Layout(
        tuple(t for t in design.layout().terms if t[0] != number),
        centre=tuple((t, m, 1.0) for t, m in centre.items()), group=number,
    )
    found = _sums(coded, layout, "gaussian", np.zeros(len(others)), np.zeros(levels))
    cross, n = found.cross[1:, 1:], found.group_cross[:, 0, 0]
    there = np.flatnonzero(n > 0)
    mean = np.zeros((levels, len(others)))
    mean[there] = found.group_fixed[there, 1:, 0] / n[there, None]
    within = cross - (mean * n[:, None]).T @ mean
    total = np.sqrt(np.maximum(np.diag(cross), 1e-300))
    place = {j: i for i, j in enumerate(others)}
    order = [place[j] for j in design.reading_order() if j in place and j in set(kept)]
    inside = tuple(sorted(_independent(within / np.outer(total, total), order)))
    constant = tuple(i for i in sorted(order) if i not in set(inside))
    if inside and constant:
        explained = np.linalg.solve(within[np.ix_(inside, inside)], within[np.ix_(inside, constant)])
    else:
        explained = np.zeros((len(inside), len(constant)))
    rest = mean[:, list(constant)] - mean[:, list(inside)] @ explained
    start = design.columns.index((longest, design.factors[longest].levels[-1]))
    dummies = np.array([j - start for j in kept if design.columns[j][0] == longest], dtype=int)
    anchors = np.setdiff1d(there, dummies)
    solve = np.linalg.inv(np.hstack([np.ones((len(anchors), 1)), rest[anchors]]))
    middle = np.array([centre.get(design.columns[j][0], 0.0) for j in others])
    return _Coding(others, inside, constant, explained, rest, anchors, solve, dummies, start, middle), layout


def fit_long(
    design: Design, coded: DataFrame, kept: tuple[int, ...], max_passes: int = 25, tol: float = 1e-10
) -> LongFit:
    """Fit the kept columns; one pass over the cells for each Newton step.

    Stops when a step changes the deviance by less than ``tol`` of it.  A level whose
    outcomes all agree has no finite effect; its effect is where the steps end.
    """
    spec = design.spec
    longest = longest_factor(design)
    coding, layout = _coding(design, coded, kept, longest)
    layout = layout.but(keep=coding.inside)
    beta, effects = np.zeros(len(coding.inside)), np.zeros(len(design.factors[longest].levels))
    before, converged, passes = None, False, 0
    last = beta, effects
    while passes < max_passes:
        sums = _sums(coded, layout, spec.family, beta, effects)
        passes += 1
        if spec.family == "binomial":
            deviance = -2.0 * sums.log_likelihood
            if before is not None and deviance > before * (1 + 1e-12) + 1e-12:
                # Too far: half the step.
                beta, effects = (beta + last[0]) / 2, (effects + last[1]) / 2
                continue
            if before is not None and abs(before - deviance) < tol * (abs(deviance) + 0.1):
                converged = True
            before = deviance
        own, mixed = sums.group_cross[:, 0, 0], sums.group_fixed[:, 1:, 0]
        live = own > 0
        weight = np.where(live, own, 1.0)
        mean = mixed / weight[:, None]
        score = sums.group_score[:, 0]
        step = np.linalg.solve(sums.cross[1:, 1:] - mean.T @ mixed, sums.score[1:] - mean.T @ score)
        move = np.where(live, (score - mixed @ step) / weight, 0.0)
        last = beta, effects
        beta, effects = beta + step, effects + move
        if converged or spec.family == "gaussian":
            converged = True
            break
    report(converged, "regression with a long factor", passes)
    return LongFit(design, kept, coding, layout, beta, effects, passes, converged)
