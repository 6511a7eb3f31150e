"""Aliased columns of designs with two long factors against the dense elimination."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areacast.models import design as design_module
from areacast.models import linear
from areacast.models.crossed import joined
from areacast.models.design import Design
from areacast.models.linear import fit_linear
from areacast.models.spec import ModelSpec, collapse
from areacast.sources.shared import settle


def graph_rows(seed, islands, each=4):
    """Rows of two factors whose levels meet within ``islands`` separate groups."""
    rng = np.random.default_rng(seed)
    out = []
    effect = rng.normal(size=(2, islands * each))
    for _ in range(60 * islands):
        i = int(rng.integers(islands))
        a, b = i * each + int(rng.integers(each)), i * each + int(rng.integers(each))
        x = float(rng.normal())
        additive = float(effect[0, a] + effect[1, b])
        out.append(
            (
                f"a{a:03d}", f"b{b * 7 % (islands * each):03d}",
                "uvw"[int(rng.integers(3))], f"i{i}", x, additive, float(effect[0, a]), 2 * x + additive,
                float(rng.random() < 0.5),
            )
        )
    return out


COLUMNS = "f string, g string, short string, island string, x double, additive double, of_f double, mixed double, y double"


@pytest.mark.parametrize(
    "fixed",
    [
        ["f", "g"],
        ["x", "f", "g", "short"],
        ["additive", "f", "g"],
        ["f", "additive", "g", "x", "mixed"],
        ["f", "g", "additive", "of_f", "x"],
        ["of_f", "x", "mixed", "g", "additive", "f", "island"],
        ["island", "short", "g", "f", "of_f"],
    ],
)
@pytest.mark.parametrize("islands", [1, 3])
def test_same_columns_as_the_dense_elimination(spark, monkeypatch, fixed, islands):
    # Levels of g are numbered so that each island's are not neighbours.
    df = spark.createDataFrame(graph_rows(len(fixed) + islands, islands, 5 if islands == 1 else 4), COLUMNS)
    spec = ModelSpec("y", fixed, family="gaussian", levels={"short": ["none", "u", "v", "w"]})
    cells = settle(collapse(df, spec), "cells")
    design = Design.build(cells, spec)
    coded = settle(design.coded(cells), "coded")
    monkeypatch.setattr(design_module, "DENSE_SECOND", 1)
    assert design.independent(coded) == design.moments(coded).kept


def test_fit_with_two_long_factors_equals_the_dense_fit(spark, monkeypatch):
    df = spark.createDataFrame(graph_rows(9, 3), COLUMNS)
    spec = ModelSpec("y", ["x", "f", "additive", "g"], family="gaussian")
    exact = fit_linear(df, spec)
    monkeypatch.setattr(linear, "MAX_DENSE", 1)
    monkeypatch.setattr(design_module, "DENSE_SECOND", 1)
    wide = fit_linear(df, spec)
    assert exact.aliased and wide.aliased == exact.aliased
    score = [f.predictor.score(df, "p").select("p").toPandas().p.to_numpy() for f in (exact, wide)]
    assert np.abs(score[0] - score[1]).max() < 1e-3


def test_two_factors_of_50_000_levels_in_two_components(spark):
    levels, half = 50_000, 25_000
    # Rings: level i of one factor meets i and i + 1 of the other, within its half.
    i = F.col("id") % levels
    start = F.floor(i / half) * half
    to = start + (i - start + F.floor(F.col("id") / levels)) % half
    df = spark.range(2 * levels).select(
        F.format_string("f%05d", i.cast("int")).alias("f"), F.format_string("g%05d", to.cast("int")).alias("g"),
        F.lit(1.0).alias("_n"), F.lit(0.0).alias("_s"),
    )
    spec = ModelSpec("y", ["f", "g"], family="gaussian")
    cells = settle(df, "cells")
    design = Design.build(cells, spec)
    kept = set(design.independent(settle(design.coded(cells), "coded")))
    aliased = [design.columns[j] for j in range(len(design.columns)) if j not in kept]
    assert aliased == [("g", "g49999")]


def test_components_of_a_path_and_loose_nodes():
    x = np.random.default_rng(1).permutation(999)
    root = joined(np.arange(1005), x, x + 1)
    assert (root[:1000] == 0).all() and root[1000:].tolist() == [1000, 1001, 1002, 1003, 1004]
