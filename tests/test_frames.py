import pytest
from conftest import collect
from pyspark.sql import functions as F

from areacast.operators import frames
from areacast.operators.poststratify import poststratify
from areacast.sources.shared import settle


def people(spark):
    rows = [
        ("a", "F", 26, 40.0, None), ("a", "F", 26, 40.0, 1.0), ("a", "M", 27, 40.0, 0.0),
        ("b", "F", 26, 55.0, 1.0), ("b", None, 26, 55.0, 1.0), ("c", "M", 30, None, 0.0),
    ]
    return spark.createDataFrame(rows, "abb string, g string, age int, share double, y double")


def test_psframe_counts_cells_with_missing_as_a_level(spark):
    out = collect(frames.psframe(people(spark), "abb", ["g", "age"]), "abb", "g")
    assert [(r["abb"], r["g"], r["age"], r["n"]) for r in out] == [
        ("a", "F", 26, 2), ("a", "M", 27, 1), ("b", "F", 26, 1), ("b", None, 26, 1), ("c", "M", 30, 1),
    ]
    assert sum(r["n"] for r in out) == 6


def test_psframe_total_equals_population(population):
    frame = frames.psframe(population, "abb", ["gender", "educ", "race", "age"])
    assert frame.agg(F.sum("n")).first()[0] == population.count()


def test_attributes_equal_grouping_by_them(population):
    narrow = frames.psframe(population, "abb", ["gender"], attributes=["division", "biden_vote_share"])
    wide = population.groupBy("abb", "gender", "division", "biden_vote_share").agg(
        F.count(F.lit(1)).alias("n")
    )
    assert collect(narrow, "abb", "gender") == collect(wide.select(narrow.columns), "abb", "gender")


def test_attribute_that_varies_is_an_error(spark):
    rows = [("a", 1.0), ("a", 2.0)]
    df = spark.createDataFrame(rows, "abb string, z double")
    with pytest.raises(Exception, match="z is not constant"):
        frames.psframe(df, "abb", [], attributes=["z"]).collect()
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "abb string, z double")
    with pytest.raises(Exception, match="z is not constant"):
        frames.psframe(df, "abb", [], attributes=["z"]).collect()


def test_weighted_frame(spark):
    df = people(spark).withColumn("w", F.lit(2.5))
    assert frames.psframe(df, "abb", [], "w").agg(F.sum("n")).first()[0] == 15.0


def test_cell_share_sums_to_one(spark):
    out = frames.cell_share(people(spark), "abb", ["g", "age"])
    assert all(abs(r["s"] - 1) < 1e-12 for r in out.groupBy("abb").agg(F.sum("prob").alias("s")).collect())
    row = out.filter("abb = 'a' and g = 'F'").first()
    assert row["prob"] == 2 / 3 and row["n"] == 2


def test_share_of_zero_total_is_missing(spark):
    counts = settle(spark.createDataFrame([("a", 0), ("b", 2)], "abb string, n long"))
    out = collect(frames.shares(counts, "abb"), "abb")
    assert [r["prob"] for r in out] == [None, 1.0]


def test_share_by_totals_equals_share(spark):
    df = people(spark)
    counts = settle(frames.psframe(df, "abb", ["g"]))
    totals = df.groupBy("abb").agg(F.count(F.lit(1)).alias("total"))
    a = frames.share_of_totals(counts, totals, "n", "total", "prob").select("abb", "g", "n", "prob")
    b = frames.shares(counts, "abb").select("abb", "g", "n", "prob")
    assert collect(a, "abb", "g") == collect(b, "abb", "g")
    with pytest.raises(ValueError, match="share no column"):
        frames.share_of_totals(counts.select("n"), totals, "n", "total", "prob")


def test_marginals_agree_with_one_at_a_time(population):
    names = ["pew_religimp", "homeowner", "urban", "parent", "military_household"]
    together = frames.marginals(population, "abb", names)
    for name in names:
        alone = frames.marginal(population, "abb", name).drop("n")
        assert together[name].schema[name].dataType == population.schema[name].dataType
        key = ("abb", name)
        assert collect(together[name], *key) == collect(alone.select(together[name].columns), *key)


def test_synthetic_frame_is_the_product_of_shares(spark):
    df = people(spark).filter("abb = 'a'")
    joint = frames.cell_share(df, "abb", ["g"])
    out = frames.synthetic_frame(joint, frames.marginals(df, "abb", ["age", "y"]), "abb")
    assert set(out.columns) == {"abb", "g", "prob", "age", "y"}
    assert out.count() == 2 * 2 * 3
    cell = out.filter("g = 'F' and age = 27 and y is null").first()
    assert abs(cell["prob"] - (2 / 3) * (1 / 3) * (1 / 3)) < 1e-15


def test_synthetic_weights_sum_to_one(population):
    joint = frames.cell_share(population, "abb", ["gender", "educ"])
    names = ["pew_religimp", "homeowner", "urban", "parent", "military_household"]
    frame = frames.synthetic_frame(joint, frames.marginals(population, "abb", names), "abb")
    per_cell = 4 * 2 * 3 * 2 * 2
    assert frame.count() == joint.count() * per_cell
    sums = frame.groupBy("abb").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_marginals_from_a_tally_equal_marginals_from_rows(population):
    tally = frames.psframe(population, "abb", ["urban", "parent", "gender"])
    a = frames.marginals_long(population, "abb", ["urban", "parent"])
    b = frames.marginals_long(tally, "abb", ["urban", "parent"], "n")
    key = ("abb", "variable", "level")
    assert collect(a, *key) == collect(b, *key)


def test_poststratify_ignores_cells_of_zero_weight(spark):
    rows = [("a", 0.5, 2), ("a", None, 0), ("b", 0.3, 0), ("c", None, 1), ("c", 0.2, 1)]
    df = spark.createDataFrame(rows, "abb string, p double, n long")
    strict = collect(poststratify(df, "abb", "p"), "abb")
    assert [r["estimate"] for r in strict] == [0.5, None, None]
    lenient = collect(poststratify(df, "abb", "p", na="skip"), "abb")
    assert [r["estimate"] for r in lenient] == [0.5, None, 0.2]
