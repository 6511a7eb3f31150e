import numpy as np
import pytest
from conftest import collect
from numeric import dummies, laplace_deviance, nelder_mead
from pyspark.sql import functions as F

from areacast.models.linear import fit_linear
from areacast.models.multilevel import fit_multilevel
from areacast.models.spec import ModelSpec, NotConverged
from areacast.operators import frames
from areacast.operators.poststratify import area_mean

SPEC = ModelSpec("defund_police", ["gender", "age"], [("division", ["biden_vote_share"])])


@pytest.fixture(scope="module")
def fit(sample):
    return fit_multilevel(sample, SPEC)


def scores(fit, frame, *key):
    rows = collect(fit.score(frame), *key)
    return np.array([r["predicted_probability"] for r in rows])


def test_converges_in_few_passes(fit):
    assert fit.converged and fit.passes < 20


def test_a_fit_that_stops_early_says_so(sample):
    with pytest.warns(NotConverged, match="2 passes"):
        early = fit_multilevel(sample, SPEC, max_passes=2)
    assert not early.converged


def test_close_to_the_laplace_optimum(sample, fit):
    pdf = sample.select("gender", "age", "division", "biden_vote_share", "defund_police").toPandas()
    y = pdf.defund_police.to_numpy()
    x = np.column_stack([np.ones(len(pdf)), dummies(pdf.gender, ["Female", "Male"]), (pdf.age - 50) / 15])
    share = pdf.biden_vote_share.to_numpy()
    s = (share - share.mean()) / share.std()
    z = np.column_stack([np.ones(len(pdf)), s])
    levels = sorted(pdf.division.unique())
    group = np.array([levels.index(v) for v in pdf.division])

    def deviance(theta):
        l = np.array([[np.exp(theta[3]), 0], [theta[4], np.exp(theta[5])]])
        return laplace_deviance(x, z, group, y, theta[:3], l @ l.T + 1e-10 * np.eye(2), steps=8)

    age = fit.coefs[[c for c, _ in fit.design.columns].index("age")]
    male = fit.coefs[[c for c, _ in fit.design.columns].index("gender")]
    chol = np.linalg.cholesky(fit.covariance + 1e-10 * np.eye(2))
    start = [fit.intercept + 50 * age, male, 15 * age, np.log(chol[0, 0]), chol[1, 0], np.log(max(chol[1, 1], 1e-4))]
    assert deviance(start) == pytest.approx(fit.deviance, abs=1e-3)
    _, best = nelder_mead(deviance, start, step=0.05, iterations=400)
    assert abs(fit.deviance - best) < 1e-3


def test_rows_and_cells_agree(sample, fit):
    tally = frames.psframe(
        sample, ["division"], ["gender", "age", "defund_police", "biden_vote_share"]
    )
    other = fit_multilevel(tally, SPEC.but(weight="n"))
    assert other.deviance == pytest.approx(fit.deviance, abs=1e-6)
    frame = frames.psframe(sample, "abb", ["gender", "age", "division", "biden_vote_share"])
    key = ("abb", "gender", "age")
    assert np.abs(scores(fit, frame, *key) - scores(other, frame, *key)).max() < 1e-6


def test_slope_units_do_not_matter(sample, fit):
    df = sample.withColumn("biden_vote_share", F.col("biden_vote_share") / 100 + 7)
    other = fit_multilevel(df, SPEC)
    a = scores(fit, frames.psframe(sample, ["division", "biden_vote_share"], ["gender", "age"]), "division", "biden_vote_share", "gender", "age")
    b = scores(other, frames.psframe(df, ["division", "biden_vote_share"], ["gender", "age"]), "division", "biden_vote_share", "gender", "age")
    assert np.abs(a - b).max() < 1e-6


def test_no_variance_is_the_pooled_model(sample):
    spec = ModelSpec("defund_police", ["gender", "educ"], [("abb", [])])
    none = fit_multilevel(sample, spec, covariance=[[1e-10]])
    plain = fit_linear(sample, spec.but(random=()))
    frame = frames.psframe(sample, "abb", ["gender", "educ"])
    key = ("abb", "gender", "educ")
    assert np.abs(scores(none, frame, *key) - scores(plain, frame, *key)).max() < 1e-6


def test_huge_variance_is_the_unpooled_model(sample):
    spec = ModelSpec("defund_police", [], [("abb", [])])
    fit = fit_multilevel(sample, spec, covariance=[[1e9]])
    out = {r["abb"]: r["predicted_probability"] for r in fit.score(frames.psframe(sample, "abb", [])).collect()}
    truth = {r["abb"]: r["truth"] for r in area_mean(sample, "abb", "defund_police").collect()}
    assert max(abs(out[a] - truth[a]) for a in truth) < 1e-6


def test_effects_shrink_towards_zero(sample):
    spec = ModelSpec("defund_police", [], [("abb", [])])
    sizes = []
    for variance in (0.001, 0.1, 10.0):
        fit = fit_multilevel(sample, spec, covariance=[[variance]])
        sizes.append(float(np.abs(fit.effects).sum()))
    assert sizes[0] < sizes[1] < sizes[2]


def test_unseen_group(spark, sample, fit):
    frame = spark.createDataFrame(
        [("x", "Female", 40, "99", 50.0), ("y", "Female", 40, None, 50.0)],
        "abb string, gender string, age int, division string, biden_vote_share double",
    )
    with pytest.raises(Exception, match="level of division not in the model: 99"):
        fit.score(frame).collect()
    out = collect(fit.score(frame, unseen="population"), "abb")
    age = fit.coefs[[c for c, _ in fit.design.columns].index("age")]
    assert out[0]["predicted_probability"] == pytest.approx(1 / (1 + np.exp(-(fit.intercept + 40 * age))))
    assert out[1]["predicted_probability"] is None


def test_tables(fit):
    coefs = fit.coefficients().collect()
    assert [r["term"] for r in coefs] == ["(Intercept)", "genderMale", "age"]
    assert all(r["std_error"] > 0 for r in coefs)
    effects = fit.group_effects().collect()
    assert {r["term"] for r in effects} == {"(Intercept)", "biden_vote_share"}
    assert len(effects) == 2 * len(fit.group.levels)


def test_bad_specs(sample):
    with pytest.raises(ValueError, match="exactly one"):
        fit_multilevel(sample, ModelSpec("defund_police", ["gender"]))
    with pytest.raises(ValueError, match="binomial"):
        fit_multilevel(sample, SPEC.but(family="gaussian"))


def test_no_group_variance_converges_at_the_boundary(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 8}", "ab"[i % 2], float(v)) for i, v in enumerate(rng.random(800) < 0.4)]
    df = spark.createDataFrame(rows, "g string, x string, y double")
    fit = fit_multilevel(df, ModelSpec("y", ["x"], [("g", [])]))
    assert fit.converged and fit.passes <= 15 and fit.covariance[0, 0] < 0.05


def test_one_group_and_separated_groups(spark):
    rows = [("only", float(i % 3 == 0)) for i in range(60)]
    one = fit_multilevel(spark.createDataFrame(rows, "g string, y double"), ModelSpec("y", [], [("g", [])]))
    assert np.isfinite(one.deviance)
    rows = [(f"g{j}", float(j < 3)) for j in range(6) for _ in range(10)]
    rows += [("g9", float(i % 2)) for i in range(10)]
    apart = fit_multilevel(spark.createDataFrame(rows, "g string, y double"), ModelSpec("y", [], [("g", [])]))
    assert np.isfinite(apart.effects).all() and apart.covariance[0, 0] > 1
