import numpy as np
import pytest
from conftest import collect
from pyspark.sql import functions as F

from areacast.models.linear import fit_linear
from areacast.operators.frames import marginals
from areacast.operators.poststratify import area_mean
from areacast.plans import studies
from areacast.sources.shared import settle


@pytest.fixture(scope="module")
def truth(population):
    return settle(studies.target(population))


def error(study):
    return study.summary.first()["mean_abs_error"]


def test_draws_have_the_asked_size(population):
    assert studies.draw(population, 1000).count() == 1000


def test_partial_pooling_beats_disaggregation(population, truth):
    sample = settle(studies.draw(population, 1000))
    plain = studies.disaggregation(sample, truth)
    pooled = studies.complete_pooling(population, sample, truth)
    partial = studies.partial_pooling(population, sample, truth, unseen="population")
    assert error(partial) < error(pooled)
    assert error(partial) < error(plain)
    assert partial.joined.columns == ["abb", "estimate", "truth"]


def test_more_data_helps(population, sample, truth):
    small = studies.partial_pooling(population, settle(studies.draw(population, 1000)), truth)
    large = studies.partial_pooling(population, sample, truth)
    assert error(large) <= error(small) + 0.003


def test_fixed_effects_behave_like_disaggregation(population, sample, truth):
    fixed = studies.fixed_effects(population, sample, truth)
    plain = studies.disaggregation(sample, truth)
    assert abs(error(fixed) - error(plain)) < 0.03


def test_a_tally_replaces_the_population(population, sample):
    tally = studies.tally(population, studies.PARTIAL_POOLING.columns)
    a = collect(studies.complete_pooling(population, sample).estimates, "abb")
    b = collect(studies.complete_pooling(tally, sample, weight="n").estimates, "abb")
    assert [r["abb"] for r in a] == [r["abb"] for r in b]
    assert np.allclose([r["estimate"] for r in a], [r["estimate"] for r in b], atol=1e-12)
    t = collect(studies.target(tally, weight="n"), "abb")
    u = collect(studies.target(population), "abb")
    assert np.allclose([r["truth"] for r in t], [r["truth"] for r in u], atol=1e-12)


def test_stacked_and_best(population, sample, truth):
    small = dict(folds=2, trees=10, max_depth=6)
    study = studies.stacked(population, sample, truth, **small)
    assert sum(study.fit.weights.values()) == pytest.approx(1)
    assert error(study) < 0.12
    full = studies.best(population, sample, truth, **small)
    assert error(full) < 0.12
    assert len(full.fit.spec.fixed) == 11


def test_synthetic_study(population, sample, truth):
    study = studies.synthetic(population, sample, truth)
    joint = studies.mrp(population, sample, studies.SYNTHETIC, studies.fit_multilevel, truth)
    a = {r["abb"]: r["estimate"] for r in study.estimates.collect()}
    b = {r["abb"]: r["estimate"] for r in joint.estimates.collect()}
    # Close for a logit model, since the extra variables are independent here.
    assert max(abs(a[k] - b[k]) for k in b) < 0.02
    assert error(study) < 0.1


def test_additive_linear_model_needs_no_joint_frame(population, sample):
    synthetic = studies.synthetic_linear(population, sample)
    joint = studies.mrp(population, sample, studies.TWO_WAY_LINEAR)
    tables = marginals(population, "abb", ["age_cat", "pew_religimp"])
    short = studies.marginal_mean(fit_linear(sample, studies.TWO_WAY_LINEAR), tables)
    a, b, c = (
        {r["abb"]: r["estimate"] for r in d.collect()}
        for d in (synthetic.estimates, joint.estimates, short)
    )
    assert max(abs(a[k] - b[k]) for k in b) < 1e-12
    assert max(abs(c[k] - b[k]) for k in b) < 1e-12
    with pytest.raises(ValueError, match="linear model"):
        studies.marginal_mean(fit_linear(sample, studies.TWO_WAY), tables)


def test_lecture_models(population, sample, truth):
    glm = studies.lecture_glm(population, sample, truth)
    sink = studies.kitchen_sink(population, sample, truth)
    lasso = studies.lasso(population, sample, truth)
    assert sink.fit.aliased == ["biden_vote_share", "homicide_rate"]
    assert all(0 < error(s) < 0.12 for s in (glm, sink, lasso))
    assert lasso.fit.coefficients().filter("estimate = 0").count() > 0
    slides = studies.kitchen_sink(population, sample, truth, spec=studies.SLIDES_KITCHEN_SINK)
    assert not any(t.startswith("educ") for t, _ in slides.fit.design.columns)
    assert error(studies.lasso(population, sample, truth, spec=studies.SLIDES_PENALISED)) < 0.12


def test_slides_table(population, sample):
    rows = studies.slides(population, sample).collect()
    values = [r["pct_support"] for r in rows]
    assert values == sorted(values)
    truth = {r["abb"]: r["truth"] for r in area_mean(population, "abb", "defund_police").collect()}
    assert {r["abb"]: r["pct_support"] for r in rows} == pytest.approx(truth)
    assert all(r["conf_low"] <= r["pct_support"] <= r["conf_high"] for r in rows)
    assert all(r["model_estimate"] is not None for r in rows)


def test_roster(spark, sample):
    fit = fit_linear(sample, studies.TWO_WAY_LINEAR)
    roster = sample.select("caseid", "age_cat", "pew_religimp")
    scored = studies.score_roster(fit, roster, "p")
    mean = studies.roster_mean(scored, "p", "mean").first()[0]
    assert mean == pytest.approx(sample.agg(F.avg("defund_police")).first()[0], abs=1e-9)
