from conftest import collect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pytest

from areacast.functions import recode as rc
from areacast.functions.stats import fold_of, hash_key, hash_uniform
from areacast.sources import codebook as cb


def column(spark, values, expression, kind="int"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["out"] for r in collect(df.select("i", expression.alias("out")), "i")]


def test_binary_keeps_missing_missing(spark):
    out = column(spark, [1, 2, None], rc.binary(F.col("x") == 1, *cb.GENDER_LABELS))
    assert out == ["Male", "Female", None]


def test_recode_without_default(spark):
    out = column(spark, [1, 6, 7, None], rc.recode("x", cb.EDUCATION))
    assert out == ["No_HS", "Post_grad", None, None]


def test_recode_with_default_takes_missing(spark):
    out = column(spark, [1, 9, None], rc.recode("x", cb.RACE, cb.RACE_DEFAULT))
    assert out == ["White", "Other", "Other"]


def test_recode_many_to_one(spark):
    out = column(spark, [1, 2, 3, 4, 5, 6], rc.recode("x", cb.URBAN))
    assert out == ["Urban", "Suburban", "Suburban", "Rural", "Suburban", None]


def test_band_edges(spark):
    out = column(spark, [29, 30, 39, 40, 69, 70, None], rc.band("x", cb.AGE_CUTS, cb.AGE_LABELS))
    assert out == ["18-29", "30-39", "30-39", "40-49", "60-69", "70+", "70+"]


def test_band_rejects_bad_cuts():
    with pytest.raises(ValueError):
        rc.band("x", (2, 1), ("a", "b", "c"))
    with pytest.raises(ValueError):
        rc.band("x", (1, 2), ("a", "b"))


def test_indicator_and_age(spark):
    assert column(spark, [1, 2, None], rc.indicator(F.col("x") == 1)) == [1.0, 0.0, None]
    assert column(spark, [1990, None], rc.age_in(2020, "x")) == [30, None]


def test_any_of_three_valued(spark):
    rows = [(0, None, 1, 2), (1, None, 2, 2), (2, 2, 2, 2), (3, 1, 1, 1)]
    df = spark.createDataFrame(rows, "i int, a int, b int, c int")
    out = collect(
        df.select(
            "i", rc.any_of("abc", 1).alias("x"), rc.any_of("abc", 1, null_as_false=True).alias("z")
        ),
        "i",
    )
    assert [r["x"] for r in out] == [1.0, None, 0.0, 1.0]
    assert [r["z"] for r in out] == [1.0, 0.0, 0.0, 1.0]


def test_flip_outcome_validates(spark):
    assert column(spark, [1, 2, 3, 8, None], rc.flip_outcome("x")) == [1.0, 0.0, None, None, None]


def test_membership_never_missing(spark):
    assert column(spark, [1, 2, None], rc.is_member("x", [1])) == [True, False, False]
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert df.filter(rc.in_set("x", [1])).count() == 1
    assert df.filter(~rc.is_member("x", [1])).count() == 2


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["CC20_334d", "Case ID", "case-id", "Other%", "2020 x"])
    assert rc.clean_names(df).columns == ["cc20_334d", "case_id", "case_id_2", "other_percent", "x2020_x"]


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=20))
def test_snake_case_is_stable(name):
    once = rc.snake_case(name)
    assert once and rc.snake_case(once) == once


def test_hash_uniform_is_uniform_and_folds_balanced(spark):
    df = spark.range(20_000).withColumn("u", hash_uniform(hash_key(["id"], 42)))
    lo, hi, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < lo and hi < 1 and abs(mean - 0.5) < 0.01
    folds = df.groupBy(fold_of(["id"], 10, 42).alias("f")).count().collect()
    assert len(folds) == 10 and all(abs(r["count"] - 2000) < 250 for r in folds)
