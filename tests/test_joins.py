import pytest
from conftest import collect
from pyspark.sql import functions as F

from areacast.operators import covariates, filters, joins


def tables(spark):
    left = spark.createDataFrame(
        [(i, None if i % 10 == 0 else f"k{i % 7 if i % 3 else 0}") for i in range(500)],
        "id int, k string",
    )
    right = spark.createDataFrame(
        [(f"k{j}", float(j)) for j in range(6)] + [(None, -1.0)], "k string, v double"
    )
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_large_lookup_side_gives_the_same_rows(spark, how, null_safe):
    left, right = tables(spark)
    small = joins.lookup_join(left, right, "k", how, null_safe)
    large = joins.lookup_join(left, right, "k", how, null_safe, max_rows=0)
    assert small.columns == large.columns
    assert collect(small, "id") == collect(large, "id")
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_without_hot_keys_nothing_is_salted(spark):
    left = spark.range(10_000).withColumnRenamed("id", "k")
    right = left.withColumn("v", F.col("k") * 2)
    out = joins.lookup_join(left, right, "k", small=False)
    assert "salt" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("v = 2 * k").count() == 10_000


def test_many_to_many_lookup(spark):
    left, _ = tables(spark)
    right = spark.createDataFrame([("k0", 1), ("k0", 2), ("k1", 3)], "k string, v int")
    small = joins.lookup_join(left, right, "k")
    large = joins.lookup_join(left, right, "k", max_bytes=0)
    assert collect(small, "id", "v") == collect(large, "id", "v")
    assert small.filter("k = 'k0'").count() == 2 * left.filter("k = 'k0'").count()


def test_null_safe_matches_missing_keys(spark):
    left, right = tables(spark)
    out = joins.lookup_join(left, right, "k", null_safe=True)
    assert out.filter("k is null").select("v").distinct().collect() == [(-1.0,)]
    plain = joins.lookup_join(left, right, "k")
    assert plain.filter("k is null and v is not null").count() == 0


def test_hot_keys(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    assert joins.hot_keys(df, ["k"]).collect() == [("hot",)]
    assert joins.hot_keys(df.filter("k <> 'hot'"), ["k"]).count() == 0


def test_hot_key_is_spread(spark):
    left = spark.range(20_000).repartition(2 * joins.SPREAD).select(F.col("id"), F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    renamed = right.select(F.col("k").alias("_r_k"), "v")
    salted, copies, spread = joins._spread_hot_keys(left, renamed, ["k"], ["_r_k"])
    assert spread
    sizes = [r["count"] for r in salted.groupBy("_salt").count().collect()]
    assert len(sizes) == joins.SPREAD and max(sizes) < 2 * 20_000 / joins.SPREAD
    assert copies.count() == joins.SPREAD + 1


def test_name_clash_is_an_error(spark):
    a = spark.createDataFrame([("x", 1)], "k string, n int")
    with pytest.raises(ValueError, match="both sides"):
        joins.lookup_join(a, a, "k")
    with pytest.raises(ValueError, match="both sides"):
        joins.area_join(a, a, "k")


def test_natural_left_join(spark):
    a = spark.createDataFrame([("x", "y", 1)], "k string, l string, n int")
    b = spark.createDataFrame([("x", "y", 2)], "k string, l string, m int")
    assert joins.natural_left_join(a, b).collect() == [("x", "y", 1, 2)]
    with pytest.raises(ValueError, match="share no column"):
        joins.natural_left_join(a.select("n"), b.select("m"))


def test_unique_by_fails_on_a_repeated_key(spark):
    ok = spark.createDataFrame([("a", 1, None), ("b", 2, 3.0)], "k string, v int, w double")
    assert collect(joins.unique_by(ok, "k"), "k") == collect(ok, "k")
    bad = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="more than one row for k = a"):
        joins.unique_by(bad, "k").collect()


def test_attach_covariates(spark):
    survey = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, abb string")
    one = spark.createDataFrame([("a", 1.5)], "abb string, rate double")
    two = spark.createDataFrame([("a", 50.0), ("z", 60.0)], "abb string, share double")
    out = collect(covariates.attach_covariates(survey, "abb", one, two), "id")
    assert [(r["rate"], r["share"]) for r in out] == [(1.5, 50.0), (None, 60.0), (None, None)]
    with pytest.raises(Exception, match="more than one row"):
        covariates.attach_covariates(survey, "abb", one.union(one)).collect()


def test_pivot_wider(spark):
    long = spark.createDataFrame(
        [("a", "D", 5), ("a", "R", 3), ("b", "D", 4), ("b", "X", 9)], "abb string, p string, v long"
    )
    wide = covariates.pivot_wider(long, "abb", "p", "v", ["D", "R"])
    assert collect(wide, "abb") == [{"abb": "a", "D": 5, "R": 3}, {"abb": "b", "D": 4, "R": None}]
    share = wide.select("abb", covariates.two_party_share(F.col("D"), F.col("R")).alias("s"))
    assert [r["s"] for r in collect(share, "abb")] == [62.5, None]
    with pytest.raises(Exception, match="more than one row for D"):
        covariates.pivot_wider(long.union(long), "abb", "p", "v", ["D", "R"]).collect()


def test_two_party_share_of_no_votes_is_missing(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int")
    assert df.select(covariates.two_party_share(F.col("a"), F.col("b"))).first()[0] is None


def test_area_threshold_is_exclusive(spark):
    rows = [("in",)] * 501 + [("out",)] * 500 + [(None,)] * 600
    df = spark.createDataFrame(rows, "abb string")
    kept = filters.keep_large_areas(df, "abb", 500)
    assert sorted((r["abb"] or "", r["count"]) for r in kept.groupBy("abb").count().collect()) == [
        ("", 600), ("in", 501),
    ]


def test_complete_cases_drops_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, 1.0), (3, "a", float("nan")), (4, "a", None)], "i int, s string, d double"
    )
    assert [r["i"] for r in filters.complete_cases(df).collect()] == [1]
    assert filters.complete_cases(df, ["s"]).count() == 3
