"""Fits that eliminate their longest factor, against the dense fits of the same designs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areacast.models.linear import fit_linear
from areacast.models.spec import ModelSpec


def rows(n=4000, areas=60, seed=5, **extra):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        area = int(rng.integers(areas))
        x, kind = float(rng.normal()), "pqr"[int(rng.integers(3))]
        eta = 0.3 * x + 0.2 * (kind == "q") + 0.5 * np.sin(area)
        y = float(rng.random() < 1 / (1 + np.exp(-eta)))
        # Constant within areas: a number, and the division that the area lies in.
        out.append((f"a{area:03d}", f"d{area % 4}", x, float(area % 7), kind, y))
    return out


SCHEMA = "area string, division string, x double, share double, kind string, y double"


@pytest.fixture(scope="module")
def survey(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("family", ["binomial", "gaussian"])
@pytest.mark.parametrize(
    "fixed",
    [
        ["area"],
        ["x", "kind", "area"],
        ["area", "share", "kind", "division", "x"],
        ["x", "share", "kind", "area"],
        ["division", "kind", "share", "x", "area"],
    ],
)
def test_estimates_errors_and_aliases_equal_the_dense_fit(survey, family, fixed):
    spec = ModelSpec("y", fixed, family=family)
    dense, long = fit_linear(survey, spec, eliminate=False), fit_linear(survey, spec, eliminate=True)
    assert long.kept == dense.kept and long.aliased == dense.aliased and long.long.converged
    assert long.intercept == pytest.approx(dense.intercept, abs=1e-8)
    assert np.abs(long.coefs - dense.coefs).max() < 1e-8
    assert np.abs(long.standard_errors() - dense.standard_errors()).max() < 1e-7


def test_a_level_without_variation_ends_far_out(spark):
    data = rows(600, 20) + [("a999", "d1", 0.1 * i, 1.0, "p", 1.0) for i in range(8)]
    df = spark.createDataFrame(data, SCHEMA)
    fit = fit_linear(df, ModelSpec("y", ["x", "area"]), eliminate=True)
    scored = fit.score(df.where("area = 'a999'")).collect()
    assert all(r["predicted_probability"] > 1 - 1e-5 for r in scored)
    inner = fit_linear(spark.createDataFrame(rows(600, 20), SCHEMA), ModelSpec("y", ["x", "area"]))
    table = {r["term"]: r["estimate"] for r in fit.coefficients().collect()}
    for r in inner.coefficients().collect():
        assert table[r["term"]] == pytest.approx(r["estimate"], abs=1e-6)


def test_a_declared_level_without_rows_is_aliased(spark):
    df = spark.createDataFrame(rows(500, 5), SCHEMA)
    levels = {"area": ["none", *[f"a{k:03d}" for k in range(5)], "never"]}
    spec = ModelSpec("y", ["x", "area"], family="gaussian", levels=levels)
    a, b = fit_linear(df, spec, eliminate=True), fit_linear(df, spec, eliminate=False)
    assert a.kept == b.kept and np.abs(a.coefs - b.coefs).max() < 1e-9


def test_a_hundred_thousand_areas_with_standard_errors(spark):
    areas, each = 100_000, 4
    df = spark.range(areas * each).selectExpr(
        f"concat('a', id % {areas}) AS area",
        "cast(pmod(xxhash64(id), 1000) / 500.0 - 1 AS double) AS x",
        "cast(pmod(xxhash64(id, 7), 100) / 100.0 AS double) AS noise",
        f"cast(id % {areas} % 5 AS double) AS level",
    ).selectExpr("area", "x", "2 * x + level + noise - 0.5 AS y")
    fit = fit_linear(df, ModelSpec("y", ["x", "area"], family="gaussian"))
    assert fit.long is not None and len(fit.kept) == areas
    assert fit.coefs[0] == pytest.approx(2, abs=0.01)
    errors = fit.standard_errors()
    # The slope within areas, by hand.
    means = df.groupBy("area").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    x = df.join(means, "area").selectExpr("sum((x - mx) * (y - my)) AS xy", "sum((x - mx) * (x - mx)) AS xx").first()
    assert fit.coefs[0] == pytest.approx(x["xy"] / x["xx"], abs=1e-9)
    variance = fit._residual_variance(areas + 1)
    assert errors[1] == pytest.approx(np.sqrt(variance / x["xx"]), rel=1e-9)
    assert np.isfinite(errors).all()
