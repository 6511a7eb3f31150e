"""The published analyses as model specifications and short compositions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.models.lasso import fit_lasso
from areacast.models.linear import LinearFit, fit_linear
from areacast.models.multilevel import fit_multilevel
from areacast.models.spec import ModelSpec
from areacast.models.stack import fit_stack, forest_learner, linear_learner
from areacast.operators import evaluate
from areacast.operators.frames import cell_share, marginals, psframe, synthetic_frame
from areacast.operators.joins import area_join
from areacast.operators.poststratify import area_mean, disaggregate, group_line, poststratify
from areacast.operators.sampling import sample_uniform
from areacast.sources.shared import settle

AREA = "abb"
ID = "caseid"
OUTCOME = "defund_police"
ATTRIBUTES = ("division", "homicide_rate", "biden_vote_share")
EXTRA = ("pew_religimp", "homeowner", "urban", "parent", "military_household")
BASIC = ("gender", "educ", "race", "age")
SLOPE = (("division", ("biden_vote_share",)),)

# First-stage models of the main analysis.
COMPLETE_POOLING = ModelSpec(OUTCOME, BASIC)
FIXED_EFFECTS = ModelSpec(OUTCOME, (*BASIC, AREA))
PARTIAL_POOLING = ModelSpec(OUTCOME, BASIC, SLOPE)
ENSEMBLE = ModelSpec(OUTCOME, (*BASIC, "division", "biden_vote_share"))
SYNTHETIC = ModelSpec(OUTCOME, (*BASIC, *EXTRA), SLOPE)
FULL_ENSEMBLE = ModelSpec(OUTCOME, (*BASIC, "division", "biden_vote_share", *EXTRA))
# Models of the short analysis.
LECTURE = ModelSpec(OUTCOME, ("gender", "age_cat", "educ", "military_household"))
KITCHEN_SINK = ModelSpec(
    OUTCOME,
    ("age_cat", "pew_religimp", "gender", "race", "urban", AREA, "educ", "biden_vote_share",
     "homicide_rate"),
    family="gaussian",
)
PENALISED = KITCHEN_SINK.but(family="binomial")
TWO_WAY_LINEAR = ModelSpec(OUTCOME, ("age_cat", "pew_religimp"), family="gaussian")
# Models of the presentation.
TWO_WAY = ModelSpec(OUTCOME, ("age_cat", "pew_religimp"))
SLIDES_KITCHEN_SINK = KITCHEN_SINK.but(
    fixed=("age_cat", "pew_religimp", "gender", "race", "urban", AREA, "biden_vote_share",
           "homicide_rate")
)
SLIDES_PENALISED = SLIDES_KITCHEN_SINK.but(family="binomial")
CHILDREN = ModelSpec("height", ("age", "gender"), family="gaussian")

LASSO_PENALTY = 0.01


@dataclass(frozen=True)
class Study:
    """Estimates per area, their comparison with the truth, and the model."""

    estimates: DataFrame
    fit: object = None
    joined: DataFrame | None = None
    summary: DataFrame | None = None


def target(population: DataFrame, outcome: str = OUTCOME, weight: str | None = None) -> DataFrame:
    """Known area values: ``truth``."""
    return area_mean(population, AREA, outcome, weight)


def tally(population: DataFrame, predictors: Sequence[str], outcome: str = OUTCOME) -> DataFrame:
    """The population as weighted cells (``n``), written once.

    Truth, frames and marginals can all be taken from it with ``weight="n"``, so
    several studies cost one pass over the respondents.
    """
    individual = [c for c in predictors if c not in ATTRIBUTES and c != AREA]
    attributes = [c for c in predictors if c in ATTRIBUTES]
    return settle(
        psframe(population, AREA, [*individual, outcome], attributes=attributes), "tally"
    )


def draw(population: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return sample_uniform(population, n, ID, seed)


def _finish(estimates, fit, truth, how="estimates") -> Study:
    if truth is None:
        return Study(estimates, fit)
    joined, summary = evaluate.compare_to_truth(estimates, truth, AREA, how)
    return Study(estimates, fit, joined, summary)


def frame_for(population: DataFrame, spec: ModelSpec, weight: str | None = None) -> DataFrame:
    """Cells of the area and every predictor of the model."""
    individual = [c for c in spec.columns if c not in ATTRIBUTES and c != AREA]
    attributes = [c for c in spec.columns if c in ATTRIBUTES]
    return psframe(population, AREA, individual, weight, attributes)


def disaggregation(sample: DataFrame, truth: DataFrame | None = None) -> Study:
    """Plain sample means by area."""
    return _finish(disaggregate(sample, AREA, OUTCOME), None, truth)


def mrp(
    population: DataFrame, sample: DataFrame, spec: ModelSpec,
    fitter: Callable = fit_linear, truth: DataFrame | None = None, weight: str | None = None,
    how: str = "estimates", **score,
) -> Study:
    """Fit on the sample, score the population's cells, average by area."""
    fit = fitter(sample, spec)
    scored = fit.score(frame_for(population, spec, weight), **score)
    return _finish(poststratify(scored, AREA), fit, truth, how)


def complete_pooling(population, sample, truth=None, weight=None) -> Study:
    return mrp(population, sample, COMPLETE_POOLING, fit_linear, truth, weight)


def fixed_effects(population, sample, truth=None, weight=None) -> Study:
    return mrp(population, sample, FIXED_EFFECTS, fit_linear, truth, weight)


def partial_pooling(population, sample, truth=None, weight=None, unseen="error") -> Study:
    return mrp(population, sample, PARTIAL_POOLING, fit_multilevel, truth, weight, unseen=unseen)


def _stack(folds, trees, max_depth, seed):
    learners = {
        "forest": forest_learner(trees=trees, max_depth=max_depth, seed=seed),
        "glm": linear_learner(),
    }
    return lambda df, spec: fit_stack(df, spec, learners, ID, folds, seed)


def stacked(population, sample, truth=None, weight=None, spec=ENSEMBLE, folds=10, trees=500,
            max_depth=30, seed=42) -> Study:
    """Stacked regression: forest and logistic regression."""
    return mrp(population, sample, spec, _stack(folds, trees, max_depth, seed), truth, weight)


def best(population, sample, truth=None, weight=None, **kwargs) -> Study:
    """Stacked regression on the full joint frame of all predictors."""
    return stacked(population, sample, truth, weight, spec=FULL_ENSEMBLE, **kwargs)


def synthetic(
    population, sample, truth=None, weight=None, spec: ModelSpec = SYNTHETIC,
    extra: Sequence[str] = EXTRA, fitter: Callable = fit_multilevel, **score,
) -> Study:
    """Score a synthetic frame: known joint cells times marginals of ``extra``.

    Expansion, scoring and the partial average run in one stage; the expanded
    frame is never stored.
    """
    fit = fitter(sample, spec)
    inner = [c for c in spec.columns if c not in extra]
    individual = [c for c in inner if c not in ATTRIBUTES and c != AREA]
    attributes = [c for c in inner if c in ATTRIBUTES]
    joint = cell_share(population, AREA, individual, weight, attributes)
    frame = synthetic_frame(joint, marginals(population, AREA, extra, weight), AREA)
    estimates = poststratify(fit.score(frame, **score), AREA, weight="prob")
    return _finish(estimates, fit, truth)


def lecture_glm(population, sample, truth=None, weight=None) -> Study:
    return mrp(population, sample, LECTURE, fit_linear, truth, weight, how="truth")


def kitchen_sink(population, sample, truth=None, weight=None, spec=KITCHEN_SINK) -> Study:
    """Linear probability model with aliased area terms."""
    return mrp(population, sample, spec, fit_linear, truth, weight, how="truth")


def lasso(population, sample, truth=None, weight=None, spec=PENALISED, penalty=LASSO_PENALTY) -> Study:
    return mrp(
        population, sample, spec, lambda df, s: fit_lasso(df, s, penalty), truth, weight, how="truth"
    )


def synthetic_linear(population, sample, truth=None, weight=None) -> Study:
    """Two-variable synthetic frame under a linear probability model."""
    return synthetic(
        population, sample, truth, weight, TWO_WAY_LINEAR, ("pew_religimp",), fit_linear
    )


def slides(population, sample, weight=None) -> DataFrame:
    """Target with interval, sample means and model estimates, side by side."""
    known = disaggregate(population, AREA, OUTCOME, weight, "pct_support", "num_respondents")
    study = mrp(population, sample, TWO_WAY, fit_linear, None, weight)
    return evaluate.caterpillar(known, disaggregate(sample, AREA, OUTCOME), study.estimates, AREA)


def marginal_mean(fit: LinearFit, tables: Mapping[str, DataFrame], area=AREA) -> DataFrame:
    """Synthetic estimate of an additive identity-link model from marginals alone.

    The mean of a sum is the sum of the means, so no cell has to be expanded.
    """
    predictor = fit.predictor
    if predictor.family != "gaussian" or predictor.groups:
        raise ValueError("needs a linear model without group effects")
    out = None
    for v, table in tables.items():
        one = fit.predictor.__class__(
            "gaussian", 0.0,
            {v: predictor.numeric[v]} if v in predictor.numeric else {},
            {v: predictor.factors[v]} if v in predictor.factors else {},
        )
        part = poststratify(one.score(table, "_part"), area, "_part", f"marginal_{v}", f"_mean_{v}")
        out = part if out is None else area_join(out, part, area)
    total = F.lit(float(predictor.intercept))
    for v in tables:
        total = total + F.col(f"_mean_{v}")
    return out.select(area, total.alias("estimate"))


CM_PER_INCH = 2.54


def children(kids: DataFrame, roster: DataFrame) -> dict[str, DataFrame]:
    """Height by age and gender: lines per gender, coefficients, scored roster, its mean.

    Heights come in inches.
    """
    data = kids.withColumn("height", F.col("height") * CM_PER_INCH)
    fit = fit_linear(data, CHILDREN)
    scored = score_roster(fit, roster)
    return {
        "lines": group_line(data, "gender", "age", "height"),
        "coefficients": fit.coefficients(),
        "scored": scored,
        "mean": roster_mean(scored),
    }


def score_roster(fit: LinearFit, roster: DataFrame, out: str = "predicted_height") -> DataFrame:
    """Predicted value for every member of a roster."""
    return fit.score(roster, out)


def roster_mean(scored: DataFrame, value: str = "predicted_height", out: str = "mean_height") -> DataFrame:
    return scored.agg(F.avg(value).alias(out))
