import numpy as np
import pytest
from numeric import dummies, lasso
from pyspark.sql import functions as F

from areacast.models.lasso import fit_lasso
from areacast.models.linear import fit_linear
from areacast.models.spec import ModelSpec
from areacast.operators import frames

SPEC = ModelSpec("defund_police", ["educ", "gender", "age", "biden_vote_share"])


def by_term(fit):
    return {r["term"]: r["estimate"] for r in fit.coefficients().collect()}


@pytest.mark.parametrize("penalty", [0.002, 0.01, 0.05])
def test_equals_proximal_gradient_on_rows(sample, penalty):
    pdf = sample.select("educ", "gender", "age", "biden_vote_share", "defund_police").toPandas()
    levels = sorted(pdf.educ.unique())
    x = np.column_stack([dummies(pdf.educ, levels), dummies(pdf.gender, ["Female", "Male"]), pdf.age, pdf.biden_vote_share])
    b0, b = lasso(x, pdf.defund_police.to_numpy(), penalty)
    got = by_term(fit_lasso(sample, SPEC, penalty))
    names = [*[f"educ{v}" for v in levels[1:]], "genderMale", "age", "biden_vote_share"]
    assert got["(Intercept)"] == pytest.approx(b0, abs=1e-5)
    assert np.abs(np.array([got[n] for n in names]) - b).max() < 1e-5


def test_rows_equal_cells(sample):
    tally = frames.psframe(sample, [], [*SPEC.fixed, "defund_police"])
    a, b = fit_lasso(sample, SPEC), fit_lasso(tally, SPEC.but(weight="n"))
    assert np.abs(a.coefs - b.coefs).max() < 1e-7 and abs(a.intercept - b.intercept) < 1e-6


def test_penalty_path_shrinks_to_the_mean(sample):
    sizes = []
    for penalty in (0.0005, 0.005, 0.05, 1.0):
        fit = fit_lasso(sample, SPEC, penalty)
        sizes.append(float(np.abs(fit.coefs).sum()))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == 0.0
    mean = sample.agg(F.avg("defund_police")).first()[0]
    assert 1 / (1 + np.exp(-fit.intercept)) == pytest.approx(mean, abs=1e-8)


def test_no_penalty_is_the_plain_model(sample):
    plain = by_term(fit_linear(sample, SPEC))
    free = by_term(fit_lasso(sample, SPEC, 0.0))
    assert all(free[t] == pytest.approx(plain[t], abs=1e-4) for t in plain)


def test_table_lists_zeros_and_constant_columns(sample):
    df = sample.withColumn("one", F.lit(1.0))
    fit = fit_lasso(df, ModelSpec("defund_police", ["one", "urban", "gender"]), 0.03)
    rows = {r["term"]: r for r in fit.coefficients().collect()}
    assert rows["one"]["estimate"] == 0.0 and rows["urbanUrban"]["estimate"] == 0.0
    assert {r["penalty"] for r in rows.values()} == {0.03}


def test_optimality_conditions_hold_for_every_column(sample):
    for mixture in (1.0, 0.5):
        fit = fit_lasso(sample, SPEC, 0.01, mixture)
        assert fit.converged and fit.violation < 1e-8
        pdf = sample.select(*SPEC.fixed, "defund_police").toPandas()
        levels = sorted(pdf.educ.unique())
        names = [*[f"educ{v}" for v in levels[1:]], "genderMale", "age", "biden_vote_share"]
        x = np.column_stack(
            [dummies(pdf.educ, levels), dummies(pdf.gender, ["Female", "Male"]), pdf.age, pdf.biden_vote_share]
        )
        got = by_term(fit)
        beta = np.array([got[t] for t in names])
        residual = pdf.defund_police - 1 / (1 + np.exp(-(got["(Intercept)"] + x @ beta)))
        scaled = (x - x.mean(axis=0)) / x.std(axis=0)
        slope = -(scaled.T @ residual) / len(x) + 0.01 * (1 - mixture) * beta * x.std(axis=0)
        assert abs(residual.mean()) < 1e-8
        on = beta != 0
        assert np.abs(slope + 0.01 * mixture * np.sign(beta))[on].max() < 1e-7
        assert (np.abs(slope[~on]) <= 0.01 * mixture + 1e-7).all()


def test_a_factor_of_a_hundred_thousand_levels(spark):
    levels = 100_000
    df = spark.range(levels * 3).selectExpr(
        f"concat('a', id % {levels}) AS area",
        f"cast(CASE WHEN id % {levels} < 5 THEN 1000 ELSE 1 END AS double) AS n",
        f"cast(CASE WHEN id % {levels} < 5 THEN id % {levels} / 5.0 ELSE pmod(xxhash64(id), 2) END AS double) AS y",
    )
    fit = fit_lasso(df, ModelSpec("y", ["area"], weight="n"), 0.01)
    assert fit.converged and fit.violation < 1e-6
    kept = {fit.design.columns[j][1] for j in np.flatnonzero(fit.coefs)}
    assert 0 < len(kept) < 10 and kept <= {f"a{k}" for k in range(5)}
