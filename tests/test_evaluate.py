import math

import pytest
from conftest import collect
from pyspark.sql import functions as F

from areacast.functions import stats
from areacast.operators import evaluate
from areacast.operators.poststratify import area_mean, disaggregate, group_line, with_interval

# Printed results of the published analysis for six areas.
AREAS = ["AL", "AR", "AZ", "CA", "CO", "CT"]
TARGET = [0.374, 0.403, 0.393, 0.480, 0.467, 0.405]
RESPONDENTS = [943, 534, 1454, 5010, 1059, 639]
SAMPLE_MEAN = [0.5, 0.276, 0.324, 0.504, 0.556, 0.5]
MODEL = [0.388, 0.389, 0.411, 0.452, 0.441, 0.435]
SAMPLE_SUMMARY = {"AL": (11, 20), "AR": (0, 4), "AZ": (7, 16), "CA": (37, 85), "CO": (11, 23),
                  "CT": (3, 8), "FL": (35, 87), "GA": (9, 26), "IA": (4, 13), "IL": (14, 50)}
SAMPLE_SUMMARY_PRINTED = {"AL": 0.55, "AR": 0, "AZ": 0.438, "CA": 0.435, "CO": 0.478, "CT": 0.375,
                          "FL": 0.402, "GA": 0.346, "IA": 0.308, "IL": 0.28}


def table(spark, values, name):
    return spark.createDataFrame(list(zip(AREAS, values)), f"abb string, {name} double")


@pytest.mark.parametrize(
    "values, error, r", [(SAMPLE_MEAN, 0.088333, 0.472828), (MODEL, 0.021667, 0.839664)]
)
def test_published_accuracy(spark, values, error, r):
    truth = table(spark, TARGET, "truth")
    joined, _ = evaluate.compare_to_truth(table(spark, values, "estimate"), truth, "abb")
    row = evaluate.metrics(joined).first()
    assert row["mean_abs_error"] == pytest.approx(error, abs=5e-7)
    assert row["correlation"] == pytest.approx(r, abs=5e-7)


def test_rounded_summary_and_caption(spark):
    truth = table(spark, TARGET, "truth")
    _, summary = evaluate.compare_to_truth(table(spark, MODEL, "estimate"), truth, "abb")
    row = evaluate.with_caption(summary).first()
    assert (row["correlation"], row["mean_abs_error"]) == (0.84, 0.022)
    assert row["caption"] == "Correlation = 0.84, Mean Absolute Error = 0.022"


def test_published_sample_summary(spark):
    rows = [(a, float(i < yes)) for a, (yes, n) in SAMPLE_SUMMARY.items() for i in range(n)]
    out = disaggregate(spark.createDataFrame(rows, "abb string, y double"), "abb", "y")
    for r in out.collect():
        assert r["num"] == SAMPLE_SUMMARY[r["abb"]][1]
        assert r["estimate"] == pytest.approx(SAMPLE_SUMMARY_PRINTED[r["abb"]], abs=5.01e-4)


def test_direction_of_the_join_matters(spark):
    truth = table(spark, TARGET, "truth")
    some = table(spark, MODEL, "estimate").filter("abb <> 'CT'")
    _, kept = evaluate.compare_to_truth(some, truth, "abb", "estimates", digits=None)
    joined, strict = evaluate.compare_to_truth(some, truth, "abb", "truth")
    assert kept.first()["mean_abs_error"] is not None
    assert strict.first().asDict() == {"correlation": None, "mean_abs_error": None}
    assert joined.count() == 6 and joined.filter("estimate is null").count() == 1
    lenient = evaluate.metrics(joined, na="skip").first()
    assert lenient["mean_abs_error"] == pytest.approx(kept.first()["mean_abs_error"])
    assert lenient["correlation"] == pytest.approx(kept.first()["correlation"])
    # The reverse: an estimate without a known value.
    _, reverse = evaluate.compare_to_truth(table(spark, MODEL, "estimate"), truth.limit(3), "abb")
    assert reverse.first()["mean_abs_error"] is None
    with pytest.raises(ValueError):
        evaluate.join_truth(some, truth, "abb", "neither")


def test_correlation_of_constant_or_single_is_missing(spark):
    truth = table(spark, TARGET, "truth")
    flat = table(spark, [0.4] * 6, "estimate")
    _, m = evaluate.compare_to_truth(flat, truth, "abb")
    assert m.first()["correlation"] is None and m.first()["mean_abs_error"] == 0.031
    _, one = evaluate.compare_to_truth(flat.limit(1), truth, "abb")
    assert one.first()["correlation"] is None


def test_mean_rules(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1), ("a", None, 2), ("b", 0.5, 1), ("c", float("nan"), 3)],
        "abb string, y double, w int",
    )
    assert [r["truth"] for r in collect(area_mean(df, "abb", "y"), "abb")] == [None, 0.5, None]
    skipped = collect(area_mean(df, "abb", "y", na="skip"), "abb")
    assert [r["truth"] for r in skipped] == [1.0, 0.5, None]
    weighted = collect(area_mean(df, "abb", "y", weight="w", na="skip"), "abb")
    assert [r["truth"] for r in weighted] == [1.0, 0.5, None]
    with pytest.raises(ValueError):
        stats.mean(F.col("y"), "whatever")


def test_skipping_masks_the_weight_as_well(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.65, 3.0), (None, 1.0)], "x double, w double")
    value = df.agg(stats.weighted_mean(F.col("x"), F.col("w"), "skip")).first()[0]
    assert value == pytest.approx(3.4875)
    assert df.agg(stats.weighted_mean(F.col("x"), F.col("w"))).first()[0] is None


def test_interval(spark):
    df = spark.createDataFrame([(0.374, 943), (0.0, 4), (0.5, 0)], "p double, n long")
    rows = with_interval(df, "p", "n").collect()
    half = 1.96 * math.sqrt(0.374 * 0.626 / 943)
    assert rows[0]["conf_low"] == pytest.approx(0.374 - half)
    assert rows[0]["conf_high"] == pytest.approx(0.374 + half)
    assert rows[1]["conf_low"] == rows[1]["conf_high"] == 0.0
    assert rows[2]["conf_low"] is None


def test_caterpillar_is_ordered_by_target(spark):
    target = table(spark, TARGET, "pct_support").join(
        spark.createDataFrame(list(zip(AREAS, RESPONDENTS)), "abb string, num_respondents long"), "abb"
    )
    drawn = table(spark, SAMPLE_MEAN, "estimate").filter("abb <> 'AZ'")
    out = evaluate.caterpillar(target, drawn, table(spark, MODEL, "estimate"), "abb").collect()
    assert [r["abb"] for r in out] == ["AL", "AZ", "AR", "CT", "CO", "CA"]
    assert out[1]["sample_estimate"] is None and out[1]["model_estimate"] == 0.411
    assert all(r["conf_low"] < r["pct_support"] < r["conf_high"] for r in out)
    ordered = evaluate.ordered_areas(target, "abb", "pct_support").collect()
    assert [r["abb"] for r in ordered] == [r["abb"] for r in out]


def test_group_line(spark):
    rows = [("F", float(x), 2.0 + 0.5 * x) for x in range(5)] + [("M", 1.0, 1.0), ("M", 3.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").withColumn("n", F.lit(2))
    for out in (group_line(df, "g", "x", "y"), group_line(df, "g", "x", "y", "n")):
        got = collect(out, "g")
        assert got[0]["intercept"] == pytest.approx(2.0) and got[0]["slope"] == pytest.approx(0.5)
        assert got[1]["intercept"] == pytest.approx(1.5) and got[1]["slope"] == pytest.approx(-0.5)


def test_logit_is_the_inverse(spark):
    df = spark.createDataFrame([(0.2,), (0.9,)], "p double")
    out = df.select(stats.inverse_logit(stats.logit(F.col("p"))).alias("q")).collect()
    assert [r["q"] for r in out] == pytest.approx([0.2, 0.9])


def test_published_scores_are_additive_on_the_logit_scale():
    """Age gap is the same for every religion level, to the printed rounding."""
    young = [0.762, 0.615, 0.526, 0.411]
    older = [0.750, 0.600, 0.510, 0.395]
    gaps = [math.log(a / (1 - a)) - math.log(b / (1 - b)) for a, b in zip(young, older)]
    assert max(gaps) - min(gaps) < 0.01
