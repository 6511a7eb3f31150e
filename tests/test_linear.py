import numpy as np
import pytest
from conftest import collect
from numeric import dummies, logistic
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from areacast.models.design import Design
from areacast.models.linear import fit_linear, fit_linear_cells
from areacast.models.predict import LinearPredictor
from areacast.models.spec import ModelSpec, collapse
from areacast.operators import frames
from areacast.operators.poststratify import area_mean, poststratify
from areacast.plans import studies
from areacast.sources.shared import settle

SPEC = ModelSpec("defund_police", ["gender", "educ", "age"])


def close(a, b, key, column, other, tol):
    left = {r[key]: r[column] for r in a.collect()}
    right = {r[key]: r[other] for r in b.collect()}
    assert left.keys() == right.keys() and left
    assert max(abs(left[k] - right[k]) for k in left) < tol


def test_logistic_equals_numpy_on_rows(sample):
    pdf = sample.select("gender", "educ", "age", "defund_police").toPandas()
    levels = sorted(pdf.educ.unique())
    x = np.column_stack([
        np.ones(len(pdf)), dummies(pdf.gender, ["Female", "Male"]), dummies(pdf.educ, levels), pdf.age,
    ])
    beta, se = logistic(x, pdf.defund_police.to_numpy())
    rows = fit_linear(sample, SPEC).coefficients().collect()
    assert [r["term"] for r in rows] == ["(Intercept)", "genderMale", *[f"educ{v}" for v in levels[1:]], "age"]
    assert np.abs([r["estimate"] for r in rows] - beta).max() < 1e-8
    assert np.abs([r["std_error"] for r in rows] - se).max() < 1e-6
    assert all(r["conf_low"] < r["estimate"] < r["conf_high"] for r in rows)


def test_weighted_cells_equal_rows(sample):
    tally = frames.psframe(sample, [], ["gender", "educ", "age", "defund_police"])
    a = fit_linear(sample, SPEC)
    b = fit_linear(tally, SPEC.but(weight="n"))
    assert abs(a.intercept - b.intercept) < 1e-10 and np.abs(a.coefs - b.coefs).max() < 1e-10


def test_gaussian_standard_errors_are_those_of_the_rows(sample):
    spec = SPEC.but(family="gaussian")
    pdf = sample.select("gender", "educ", "age", "defund_police").toPandas()
    levels = sorted(pdf.educ.unique())
    x = np.column_stack([
        np.ones(len(pdf)), dummies(pdf.gender, ["Female", "Male"]), dummies(pdf.educ, levels), pdf.age,
    ])
    y = pdf.defund_police.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = np.sum((y - x @ beta) ** 2) / (len(y) - x.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    rows = fit_linear(sample, spec).coefficients().collect()
    assert np.abs([r["estimate"] for r in rows] - beta).max() < 1e-10
    assert np.abs([r["std_error"] for r in rows] - se).max() < 1e-10


def test_standard_errors_equal_the_built_in_learner(sample):
    cells = settle(collapse(sample, SPEC))
    fit = fit_linear_cells(cells, SPEC)
    data = Design.build(cells, SPEC).vectors(cells).withColumn("label", F.col("_s") / F.col("_n"))
    glr = GeneralizedLinearRegression(family="binomial", weightCol="_n", tol=1e-10).fit(data)
    built_in = glr.summary.coefficientStandardErrors
    assert np.abs(fit.standard_errors()[1:] - built_in[:-1]).max() < 1e-6
    assert abs(fit.standard_errors()[0] - built_in[-1]) < 1e-6


def test_no_predictors_give_the_sample_mean_everywhere(population, sample):
    mean = sample.agg(F.avg("defund_police")).first()[0]
    for family in ("binomial", "gaussian"):
        study = studies.mrp(population, sample, ModelSpec("defund_police", family=family))
        values = [r["estimate"] for r in study.estimates.collect()]
        assert max(abs(v - mean) for v in values) < 1e-12


@pytest.mark.parametrize("family", ["binomial", "gaussian"])
def test_saturated_factor_gives_group_means(sample, family):
    fit = fit_linear(sample, ModelSpec("defund_police", ["race"], family=family))
    scored = fit.score(frames.psframe(sample, [], ["race"]))
    close(scored, area_mean(sample, "race", "defund_police"), "race", "predicted_probability", "truth", 1e-10)


@pytest.mark.parametrize("family", ["binomial", "gaussian"])
def test_area_terms_return_area_means_on_their_own_cells(sample, family):
    spec = ModelSpec("defund_police", ["gender", "age_cat", "abb"], family=family)
    study = studies.mrp(sample, sample, spec)
    close(study.estimates, area_mean(sample, "abb", "defund_police"), "abb", "estimate", "truth", 1e-9)


def test_separated_area_is_fitted_near_zero(spark):
    rows = [(a, g, float(a != "z" and (i + k) % 3 == 0)) for k, a in enumerate("xyz") for g in "FM" for i in range(20)]
    df = spark.createDataFrame(rows, "abb string, g string, y double")
    fit = fit_linear(df, ModelSpec("y", ["g", "abb"]))
    out = {r["abb"]: r["estimate"] for r in poststratify(fit.score(frames.psframe(df, "abb", ["g"])), "abb").collect()}
    assert out["z"] < 1e-5 and 0.2 < out["x"] < 0.5


def test_aliased_terms_are_dropped_in_reading_order(sample):
    spec = ModelSpec(
        "defund_police", ["age_cat", "abb", "biden_vote_share", "homicide_rate"], family="gaussian"
    )
    fit = fit_linear(sample, spec)
    assert fit.aliased == ["biden_vote_share", "homicide_rate"]
    without = fit_linear(sample, spec.but(fixed=["age_cat", "abb"]))
    table = {r["term"]: r for r in fit.coefficients().collect()}
    plain = {r["term"]: r for r in without.coefficients().collect()}
    assert table["homicide_rate"]["estimate"] is None and table["homicide_rate"]["std_error"] is None
    for term, row in plain.items():
        assert table[term]["estimate"] == pytest.approx(row["estimate"], abs=1e-9)
        assert table[term]["std_error"] == pytest.approx(row["std_error"], abs=1e-9)
    # The covariates first: now area terms have to give way.
    other = fit_linear(sample, spec.but(fixed=["biden_vote_share", "homicide_rate", "abb"]))
    assert len(other.aliased) == 2 and all(a.startswith("abb") for a in other.aliased)


def test_constant_columns_are_aliased(sample):
    df = sample.withColumn("one", F.lit(1.0)).withColumn("same", F.lit("x"))
    fit = fit_linear(df, ModelSpec("defund_police", ["one", "gender", "same"]))
    assert fit.aliased == ["one"]
    plain = fit_linear(df, ModelSpec("defund_police", ["gender"]))
    assert fit.intercept == pytest.approx(plain.intercept, abs=1e-9)
    only = fit_linear(df, ModelSpec("defund_police", ["one", "same"]))
    assert only.kept == ()


def test_declared_level_order_sets_the_baseline(sample):
    spec = ModelSpec("defund_police", ["gender"], levels={"gender": ["Male", "Female", "Other"]})
    fit = fit_linear(sample, spec)
    terms = [r["term"] for r in fit.coefficients().collect()]
    assert terms == ["(Intercept)", "genderFemale", "genderOther"]
    assert fit.aliased == ["genderOther"]
    with pytest.raises(ValueError, match="undeclared"):
        fit_linear(sample, spec.but(levels={"gender": ["Male"]}))


def test_numeric_term_can_be_a_factor(sample):
    spec = ModelSpec("defund_police", ["parent"], levels={"parent": ["0.0", "1.0"]})
    assert [r["term"] for r in fit_linear(sample, spec).coefficients().collect()] == ["(Intercept)", "parent1.0"]


def test_unseen_and_missing_levels_at_scoring(spark, sample):
    fit = fit_linear(sample, ModelSpec("defund_police", ["gender", "age"]))
    frame = spark.createDataFrame([("a", "Male", 30), ("b", None, 30), ("c", "Female", None)], "abb string, gender string, age int")
    out = [r["predicted_probability"] for r in collect(fit.score(frame), "abb")]
    assert out[0] is not None and out[1:] == [None, None]
    bad = spark.createDataFrame([("a", "Unknown", 30)], "abb string, gender string, age int")
    with pytest.raises(Exception, match="level of gender not in the model: Unknown"):
        fit.score(bad).collect()


def test_long_level_lists_score_through_a_table(spark):
    levels = {f"L{i:03d}": i / 100 for i in range(150)}
    p = LinearPredictor("gaussian", 1.0, {"x": 2.0}, {"g": levels})
    frame = spark.createDataFrame([("L007", 1.0), (None, 1.0), ("L149", None)], "g string, x double")
    out = collect(p.score(frame, "eta"), "g")
    assert [r["eta"] for r in out] == pytest.approx([3.07, None, None])
    assert set(p.score(frame, "eta").columns) == {"g", "x", "eta"}
    with pytest.raises(Exception, match="not in the model"):
        p.score(spark.createDataFrame([("new", 1.0)], "g string, x double"), "eta").collect()


def test_wide_designs_use_the_iterative_learners(sample, monkeypatch):
    import areacast.models.linear as linear

    for family in ("binomial", "gaussian"):
        spec = ModelSpec("defund_police", ["gender", "race"], family=family)
        exact = fit_linear(sample, spec)
        monkeypatch.setattr(linear, "MAX_DENSE", 1)
        wide = fit_linear(sample, spec)
        monkeypatch.undo()
        assert np.abs(exact.coefs - wide.coefs).max() < 1e-4


@pytest.mark.parametrize("family", ["binomial", "gaussian"])
def test_wide_designs_leave_out_the_same_aliased_columns(spark, monkeypatch, family):
    import areacast.models.linear as linear

    rng = np.random.default_rng(5)
    area = rng.integers(0, 12, 900)
    share = np.round(rng.normal(50, 9, 12), 2)
    y = (rng.random(900) < 1 / (1 + np.exp(0.05 * (50 - share[area])))).astype(float)
    sex, x = rng.integers(0, 2, 900), np.round(rng.normal(size=900), 1)
    df = spark.createDataFrame(
        [
            (f"a{a:02d}", f"d{a % 3}", float(share[a]), "FM"[s], float(v), float(2 * v + 1), float(o))
            for a, s, v, o in zip(area, sex, x, y)
        ],
        "area string, division string, share double, sex string, x double, twice double, y double",
    )
    empty = {"area": ["none", *(f"a{i:02d}" for i in range(12)), "never"]}
    for fixed, levels in [
        (["share", "sex", "area"], {}),
        (["sex", "area", "share", "x", "division", "twice"], {}),
        (["division", "share", "x", "area", "twice"], {}),
        (["share", "area", "division"], empty),
    ]:
        spec = ModelSpec("y", fixed, family=family, levels=levels)
        exact = fit_linear(df, spec)
        monkeypatch.setattr(linear, "MAX_DENSE", 1)
        wide = fit_linear(df, spec)
        monkeypatch.undo()
        assert exact.aliased and wide.aliased == exact.aliased
        assert abs(wide.intercept - exact.intercept) < 1e-3
        assert np.abs(exact.coefs - wide.coefs).max() < 1e-3


def test_outcome_outside_the_unit_interval_is_an_error(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "g string, y double")
    with pytest.raises(Exception, match="must lie in"):
        fit_linear(df, ModelSpec("y", ["g"]))


def test_incomplete_rows_are_left_out(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("b", 0.0), (None, 1.0), ("a", None)],
        "g string, y double",
    )
    fit = fit_linear(df, ModelSpec("y", ["g"], family="gaussian"))
    assert fit.intercept == pytest.approx(0.5) and fit.coefs[0] == pytest.approx(1 / 6)


def test_children_roster_reproduces_the_printed_heights(spark):
    # Printed coefficients and predictions.
    predictor = LinearPredictor(
        "gaussian", 63.7516508, {"age": 0.6118978}, {"gender": {"F": 0.0, "M": -0.6610833}}
    )
    rows = [("Marco", "M", 72.0), ("Roberto", "M", 54.0), ("Anna", "F", 60.0), ("Maria", "F", 80.0), ("Luca", "M", 36.0)]
    roster = spark.createDataFrame(rows, "name string, gender string, age double")
    scored = predictor.score(roster, "predicted_height")
    heights = {r["name"]: round(r["predicted_height"], 1) for r in scored.collect()}
    assert heights == {"Marco": 107.1, "Roberto": 96.1, "Anna": 100.5, "Maria": 112.7, "Luca": 85.1}
    assert round(studies.roster_mean(scored).first()[0], 1) == 100.3


def test_children_model_recovers_a_known_line(spark):
    rng = np.random.default_rng(1)
    age = rng.integers(3, 145, 400).astype(float)
    male = rng.random(400) < 0.5
    inches = (63.75 + 0.61 * age - 0.66 * male + rng.normal(0, 3, 400)) / 2.54
    kids = spark.createDataFrame(
        [(float(a), "M" if m else "F", float(h)) for a, m, h in zip(age, male, inches)],
        "age double, gender string, height double",
    )
    roster = spark.createDataFrame([("Anna", "F", 60.0), ("Luca", "M", 36.0)], "name string, gender string, age double")
    out = studies.children(kids, roster)
    rows = out["coefficients"].collect()
    assert [r["term"] for r in rows] == ["(Intercept)", "age", "genderM"]
    x = np.column_stack([np.ones(400), age, male])
    expected = np.linalg.lstsq(x, inches * 2.54, rcond=None)[0]
    assert [r["estimate"] for r in rows] == pytest.approx(list(expected), abs=1e-8)
    heights = np.array([[1, 60, 0], [1, 36, 1]]) @ expected
    assert [r["predicted_height"] for r in collect(out["scored"], "name")] == pytest.approx(list(heights))
    assert out["mean"].first()[0] == pytest.approx(heights.mean())
    for r in out["lines"].collect():
        own = male == (r["gender"] == "M")
        slope, intercept = np.polyfit(age[own], inches[own] * 2.54, 1)
        assert (r["slope"], r["intercept"]) == pytest.approx((slope, intercept))


def test_bad_specs():
    with pytest.raises(ValueError):
        ModelSpec("y", family="poisson")
    with pytest.raises(ValueError):
        fit_linear_cells(None, ModelSpec("y", ["x"], [("g", [])]))
