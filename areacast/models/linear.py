"""Logistic and least-squares regression on weighted cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.functions.stats import Z95
from areacast.models.design import MAX_DENSE, Design
from areacast.models.gram import accumulate
from areacast.models.longfactor import LongFit, fit_long, longest_factor
from areacast.models.predict import LinearPredictor
from areacast.models.spec import ModelSpec, collapse
from areacast.sources.shared import settle

INTERCEPT = "(Intercept)"


def two_rows_per_cell(cells: DataFrame) -> DataFrame:
    """0/1 labels for learners that need them: weight _s for 1, _n - _s for 0."""
    pair = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("_s").alias("_w")),
        F.struct(F.lit(0.0).alias("label"), (F.col("_n") - F.col("_s")).alias("_w")),
    )
    out = cells.withColumn("_p", F.explode(pair))
    return (
        out.withColumns({"label": F.col("_p.label"), "_w": F.col("_p._w")})
        .drop("_p")
        .filter(F.col("_w") > 0)
    )


def predictor_from(design: Design, family: str, intercept: float, coefs) -> LinearPredictor:
    """Coefficients in design order turned into a scorer; 0 for what is left out."""
    numeric: dict[str, float] = {}
    factors = {t: dict.fromkeys(design.factors[t].levels, 0.0) for t in design.spec.fixed if t in design.factors}
    for (term, level), value in zip(design.columns, coefs):
        if level is None:
            numeric[term] = float(value)
        else:
            factors[term][level] = float(value)
    return LinearPredictor(family, float(intercept), numeric, factors)


@dataclass(frozen=True)
class LinearFit:
    """A fitted regression.  ``kept`` are the estimated design columns."""

    spec: ModelSpec
    design: Design
    intercept: float
    coefs: np.ndarray
    kept: tuple[int, ...]
    predictor: LinearPredictor
    cells: DataFrame
    long: LongFit | None = None

    def score(self, frame: DataFrame, out: str = "predicted_probability", **kwargs) -> DataFrame:
        return self.predictor.score(frame, out, **kwargs)

    @property
    def aliased(self) -> list[str]:
        dropped = set(range(len(self.design.columns))) - set(self.kept)
        return [term_name(*self.design.columns[j]) for j in self.design.reading_order() if j in dropped]

    def standard_errors(self) -> np.ndarray:
        """Intercept first, then the kept columns, from one pass over the cells."""
        if self.long is not None:
            errors = self.long.standard_errors(self.design.coded(self.cells))
            return errors * np.sqrt(self._residual_variance(len(self.kept) + 1))
        layout = self.design.layout().but(keep=self.kept)
        beta = np.concatenate([[self.intercept], self.coefs[list(self.kept)]])
        coded = self.design.coded(self.cells)
        sums = accumulate(coded, layout, self.spec.family, beta)
        try:
            covariance = np.linalg.inv(sums.cross)
        except np.linalg.LinAlgError:
            return np.full(len(beta), np.nan)
        covariance = covariance * self._residual_variance(len(beta))
        variances = np.diag(covariance)
        scale = np.sqrt(np.abs(np.diag(sums.cross)))
        scaled = sums.cross / np.outer(scale, scale) if (scale > 0).all() else None
        if scaled is None or np.linalg.cond(scaled) > 1e12 or (variances < 0).any():
            return np.full(len(beta), np.nan)
        return np.sqrt(variances)

    def _residual_variance(self, coefficients: int) -> float:
        """Of the respondents, not of the cell means; 1 for a binomial outcome."""
        if self.spec.family != "gaussian":
            return 1.0
        mu = self.predictor.score(self.cells, "_mu")
        rss, n = mu.agg(
            F.sum(F.col("_q") - 2 * F.col("_mu") * F.col("_s") + F.col("_n") * F.col("_mu") ** 2),
            F.sum("_n"),
        ).first()
        free = n - coefficients
        return max(rss, 0.0) / free if free > 0 else math.nan

    def coefficients(self, z: float = Z95) -> DataFrame:
        """Table of term, estimate, std_error, conf_low and conf_high.

        Aliased terms are listed with missing values.
        """
        errors = self.standard_errors()
        by_column = dict(zip(self.kept, errors[1:]))
        rows = [_row(INTERCEPT, self.intercept, errors[0], z)]
        for j in self.design.reading_order():
            name = term_name(*self.design.columns[j])
            if j in by_column:
                rows.append(_row(name, float(self.coefs[j]), by_column[j], z))
            else:
                rows.append((name, None, None, None, None))
        return self.cells.sparkSession.createDataFrame(
            rows,
            "term string, estimate double, std_error double, conf_low double, conf_high double",
        )


def term_name(term: str, level: str | None) -> str:
    return term if level is None else f"{term}{level}"


def _row(name, estimate, error, z):
    estimate, error = float(estimate), float(error)
    if math.isnan(error):
        return (name, estimate, None, None, None)
    return (name, estimate, error, estimate - z * error, estimate + z * error)


def fit_linear(df: DataFrame, spec: ModelSpec, **kwargs) -> LinearFit:
    """Fit from respondents (or weighted rows); reduces them to cells first."""
    return fit_linear_cells(settle(collapse(df, spec), "cells"), spec, **kwargs)


def fit_linear_cells(cells: DataFrame, spec: ModelSpec, eliminate: bool | None = None) -> LinearFit:
    """Fit by iteratively reweighted least squares on settled cells.

    ``eliminate`` takes the longest factor out of the matrix that is solved (see
    ``longfactor``); the estimates are the same.  By default designs do so that would
    have more than ``MAX_DENSE`` columns with it and not without it.
    """
    if spec.random:
        raise ValueError("random terms need fit_multilevel")
    if not spec.fixed:
        return _fit_mean(cells, spec)
    design = Design.build(cells, spec)
    wide = len(design.columns) > MAX_DENSE
    coded = design.coded(cells)
    longest = longest_factor(design)
    long = longest is not None and len(design.factors[longest].levels) > 1
    if eliminate is None:
        eliminate = wide and long and len(design.columns) - len(design.factors[longest].levels) < MAX_DENSE
    if wide or (eliminate and long):
        # Read once a step.
        coded = settle(coded, "coded")
    kept = design.independent(coded) if wide or eliminate else design.moments(coded).kept
    if not kept:
        return _fit_mean(cells, spec, design)
    if eliminate and long:
        found = fit_long(design, coded, kept)
        intercept, coefs = found.coefficients()
        predictor = predictor_from(design, spec.family, intercept, coefs)
        return LinearFit(spec, design, intercept, coefs, kept, predictor, cells, found)
    data = design.vectors(cells)
    features = "features"
    if len(kept) < len(design.columns):
        data = VectorSlicer(inputCol="features", outputCol="_kept", indices=list(kept)).transform(data)
        features = "_kept"
    if wide and spec.family == "binomial":
        data = two_rows_per_cell(data).select(F.col(features).alias("features"), "label", "_w").persist()
        model = LogisticRegression(weightCol="_w", maxIter=500, tol=1e-10).fit(data)
    else:
        data = data.select(
            F.col(features).alias("features"), (F.col("_s") / F.col("_n")).alias("label"), "_n"
        ).persist()
        if wide:
            model = LinearRegression(weightCol="_n", solver="l-bfgs", maxIter=500, tol=1e-10).fit(data)
        elif spec.family == "binomial":
            model = GeneralizedLinearRegression(
                family="binomial", link="logit", weightCol="_n", maxIter=25, tol=1e-10
            ).fit(data)
        else:
            model = LinearRegression(weightCol="_n", solver="normal").fit(data)
    data.unpersist()
    coefs = np.zeros(len(design.columns))
    coefs[list(kept)] = model.coefficients.toArray()
    predictor = predictor_from(design, spec.family, model.intercept, coefs)
    return LinearFit(spec, design, float(model.intercept), coefs, kept, predictor, cells)


def _fit_mean(cells: DataFrame, spec: ModelSpec, design: Design | None = None) -> LinearFit:
    """No usable predictor: the fitted value is the sample mean."""
    design = design or Design(spec, {}, ())
    s, n = cells.agg(F.sum("_s"), F.sum("_n")).first()
    if not n:
        raise ValueError("no complete rows to fit")
    mean = s / n
    if spec.family == "binomial":
        if mean in (0.0, 1.0):
            intercept = -30.0 if mean == 0.0 else 30.0
        else:
            intercept = math.log(mean / (1 - mean))
    else:
        intercept = mean
    coefs = np.zeros(len(design.columns))
    predictor = predictor_from(design, spec.family, intercept, coefs)
    return LinearFit(spec, design, intercept, coefs, (), predictor, cells)
