import itertools

import numpy as np
import pytest
from conftest import collect
from pyspark.sql import functions as F

from areacast.models.forest import fit_forest
from areacast.models.linear import fit_linear
from areacast.models.spec import ModelSpec, collapse
from areacast.models.stack import fit_stack, fold_table, forest_learner, linear_learner, nonnegative_weights
from areacast.operators import frames
from areacast.operators.sampling import with_fold

SPEC = ModelSpec("defund_police", ["gender", "race", "age", "division", "biden_vote_share"])


def test_forest_takes_many_levels(spark):
    rows = [(f"L{i % 60:02d}", float((i * 7) % 3 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "g string, y double")
    fit = fit_forest(df, ModelSpec("y", ["g"]), trees=5, max_depth=5)
    frame = frames.psframe(df, [], ["g"])
    out = fit.score(frame)
    assert out.columns == ["g", "n", "predicted_probability"]
    assert all(0 <= r["predicted_probability"] <= 1 for r in out.collect())
    with pytest.raises(Exception, match="Unseen label"):
        fit.score(spark.createDataFrame([("new", 1)], "g string, n int")).collect()


def test_forest_learns_an_interaction(spark):
    rows = [(a, b, float((a == "x") != (b == "x")), i) for i in range(100) for a in "xy" for b in "xy"]
    df = spark.createDataFrame(rows, "a string, b string, y double, i int")
    spec = ModelSpec("y", ["a", "b"])
    forest = fit_forest(df, spec, trees=40, max_depth=4).score(df.select("a", "b").distinct())
    linear = fit_linear(df, spec).score(df.select("a", "b").distinct())
    # One of the two terms is tried per split, and a split that repeats the first term
    # finds it constant and stops there: an error near 1/4 is what such trees give.
    for r in forest.collect():
        assert abs(r["predicted_probability"] - float((r["a"] == "x") != (r["b"] == "x"))) < 0.35
    assert all(abs(r["predicted_probability"] - 0.5) < 1e-6 for r in linear.collect())


def test_forest_is_reproducible(sample):
    frame = frames.psframe(sample, "abb", ["gender", "race", "age"], attributes=["division", "biden_vote_share"])
    a, b = (
        collect(fit_forest(sample, SPEC, trees=5, max_depth=5).score(frame), "abb", "gender", "race", "age")
        for _ in range(2)
    )
    assert a == b


def test_weights_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        z = rng.random((200, 3))
        y = z @ [0.7, 0.0, 0.4] + rng.normal(0, 0.1, 200)
        w = nonnegative_weights(z.T @ z, z.T @ y)
        grid = np.linspace(0, 1.2, 25)
        best = min(
            (np.sum((y - z @ np.array(p)) ** 2), p) for p in itertools.product(grid, repeat=3)
        )[1]
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        assert np.abs(w - np.array(best) / sum(best)).max() < 0.08


def test_negative_member_gets_no_weight():
    rng = np.random.default_rng(4)
    a = rng.random(300)
    z = np.column_stack([a, 1 - a])
    y = 2 * a - 0.5 * (1 - a)
    w = nonnegative_weights(z.T @ z, z.T @ y)
    assert list(w) == [1.0, 0.0]


def test_stack(sample):
    learners = {"forest": forest_learner(trees=10, max_depth=5), "glm": linear_learner()}
    fit = fit_stack(sample, SPEC, learners, "caseid", folds=3)
    assert all(w >= 0 for w in fit.weights.values())
    assert sum(fit.weights.values()) == pytest.approx(1)

    # Out-of-fold risk of the regression, fold by fold.
    tagged = with_fold(sample, "caseid", 3)
    total = 0.0
    for k in range(3):
        member = fit_linear(tagged.filter(F.col("fold") != k), SPEC)
        held = member.score(tagged.filter(F.col("fold") == k))
        total += held.agg(F.sum((F.col("defund_police") - F.col("predicted_probability")) ** 2)).first()[0]
    assert fit.risk["glm"] == pytest.approx(total / sample.count(), abs=1e-9)

    frame = frames.psframe(sample, "abb", ["gender", "race", "age"], attributes=["division", "biden_vote_share"])
    scored = fit.score(frame)
    for name, member in fit.members.items():
        scored = member.score(scored, name)
    gap = scored.select(
        F.max(F.abs(F.col("predicted_probability") - sum(F.col(k) * w for k, w in fit.weights.items())))
    ).first()[0]
    assert gap < 1e-12
    assert {r["learner"] for r in fit.member_table().collect()} == {"forest", "glm"}


def test_level_seen_only_in_one_fold(spark):
    rows = [(i, "rare" if i == 0 else "abc"[i % 3], float(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, y double")
    fit = fit_stack(df, ModelSpec("y", ["g"]), {"glm": linear_learner()}, "id", folds=4)
    assert fit.weights == {"glm": 1.0}


def test_forest_returns_the_share_of_each_level(spark):
    shares = [0.05 + 0.04 * k for k in range(10)]
    rows = [(f"l{k}", float(y), 1000 * (p if y else 1 - p)) for k, p in enumerate(shares) for y in (0, 1)]
    df = spark.createDataFrame(rows, "g string, y double, n double")
    fit = fit_forest(df, ModelSpec("y", ["g"], weight="n"), trees=50, max_depth=8)
    scored = fit.score(df.select("g").distinct()).collect()
    for r in scored:
        assert abs(r["predicted_probability"] - shares[int(r["g"][1:])]) < 0.02


def test_one_tree_varies_like_respondents_drawn_one_by_one(spark):
    sizes, cells = (64, 1_000, 50_000), 40
    rows = [(f"{n}_{k:02d}", float(y), n * (0.3 if y else 0.7)) for n in sizes for k in range(cells) for y in (0, 1)]
    df = spark.createDataFrame(rows, "g string, y double, n double")
    fit = fit_forest(df, ModelSpec("y", ["g"], weight="n"), trees=60)
    x = np.arange(len(sizes) * cells, dtype=float)[:, None]
    names = sorted({r[0] for r in rows})
    one = np.column_stack([fit.trees.some(np.array([t])).total(x) for t in range(60)])
    for n in sizes:
        mine = [i for i, g in enumerate(names) if g.startswith(f"{n}_")]
        expected = np.sqrt(0.3 * 0.7 / n)
        assert np.std(one[mine] - 0.3) == pytest.approx(expected, rel=0.1)


def test_forest_does_not_depend_on_partitions_or_on_where_nodes_are_split(spark):
    rng = np.random.default_rng(6)
    rows = [
        (f"a{rng.integers(6)}", float(rng.normal()), f"c{rng.integers(3)}", float(rng.random() < 0.4), 1.0 + i % 7)
        for i in range(700)
    ]
    df = spark.createDataFrame(rows, "a string, x double, c string, y double, n double")
    spec = ModelSpec("y", ["a", "x", "c"], weight="n")
    frame = df.select("a", "x", "c").distinct()

    def scores(data, **kwargs):
        out = fit_forest(data, spec, trees=8, tried=2, **kwargs).score(frame)
        return collect(out, "a", "x", "c")

    one = scores(df.repartition(1))
    assert scores(df.repartition(7)) == one
    assert scores(df, local_cells=90) == one
    assert scores(df, seed=43) != one


def test_full_tree_ends_at_the_cells(spark):
    rows = [(a, b, float((a * 3 + b) % 4), float(5 + a + b)) for a in range(6) for b in range(5)]
    data = [(a, b, y, n) for a, b, s, n in rows for y, n in ((1.0, s), (0.0, n - s)) if n > 0]
    df = spark.createDataFrame(data, "a int, b int, y double, n double")
    fit = fit_forest(df, ModelSpec("y", ["a", "b"], weight="n"), trees=1, tried=2, bootstrap=False)
    got = {(r["a"], r["b"]): r["p"] for r in fit.score(df.select("a", "b").distinct(), "p").collect()}
    assert got == pytest.approx({(a, b): s / n for a, b, s, n in rows})
    stump = fit_forest(df, ModelSpec("y", ["a"], weight="n"), trees=1, bootstrap=False, max_depth=1)
    assert len(stump.trees.term) == 3
    few = fit_forest(df, ModelSpec("y", ["a", "b"], weight="n"), trees=1, bootstrap=False, min_node=10_000)
    assert len(few.trees.term) == 1


def test_forest_scores_missing_values_as_missing(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 2)) for i in range(50)], "x double, y double")
    fit = fit_forest(df, ModelSpec("y", ["x"]), trees=3)
    out = fit.score(spark.createDataFrame([(1.0,), (None,)], "x double")).collect()
    assert out[0]["predicted_probability"] is not None and out[1]["predicted_probability"] is None


def test_trees_broadcast_in_parts_score_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i % 11, float(i % 3 == 0)) for i in range(200)], "x int, y double")
    fit = fit_forest(df, ModelSpec("y", ["x"]), trees=12)
    frame = df.select("x").distinct()
    whole = collect(fit.score(frame), "x")
    monkeypatch.setattr("areacast.models.forest.PART_BYTES", 500)
    parts = type(fit)(fit.spec, fit.factors, fit.trees)
    assert len(parts._parts) > 3
    assert np.allclose(
        [r["predicted_probability"] for r in whole],
        [r["predicted_probability"] for r in collect(parts.score(frame), "x")], atol=1e-12,
    )


def test_a_fold_is_trained_on_the_whole_minus_its_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(4)), f"g{rng.integers(3)}", float(rng.random() < 0.5), 0.1 * int(rng.integers(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "fold int, g string, y double, w double")
    spec = ModelSpec("y", ["g"], weight="w")
    table = fold_table(collapse(df, spec, extra=["fold"]), ["g"], 4, "fold")
    for k in range(4):
        want = {r["g"]: r["_n"] for r in collapse(df.filter(F.col("fold") != k), spec).collect()}
        got = {r["g"]: r["_n"] - r["_n_by_fold"][k] for r in table.collect()}
        assert got == pytest.approx(want)
