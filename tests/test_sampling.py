import math

import pytest
from conftest import collect
from pyspark.sql import functions as F

from areacast.functions.stats import hash_key, hash_uniform
from areacast.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(50_000).withColumn("w", (F.col("id") % 10).cast("double"))


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("n", [1, 7, 1000, 49_999])
def test_uniform_sample_equals_a_global_sort(rows, n):
    expected = rows.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id").limit(n)
    out = sampling.sample_uniform(rows, n, "id")
    assert out.columns == rows.columns
    assert out.count() == n
    assert ids(out) == ids(expected)


def test_sample_does_not_depend_on_partitioning(rows):
    a = ids(sampling.sample_uniform(rows.repartition(3, "w"), 500, "id"))
    b = ids(sampling.sample_uniform(rows.repartition(31), 500, "id"))
    assert a == b


def test_samples_nest_and_seeds_differ(rows):
    small = ids(sampling.sample_uniform(rows, 100, "id"))
    assert small < ids(sampling.sample_uniform(rows, 1000, "id"))
    other = ids(sampling.sample_uniform(rows, 100, "id", seed=1))
    assert len(small & other) < 10


def test_sample_larger_than_the_table_is_the_table(rows):
    few = rows.limit(5)
    assert sampling.sample_uniform(few, 10, "id").count() == 5
    assert sampling.sample_uniform(few, 0, "id").count() == 0


def test_uniform_sample_is_fair(rows):
    out = sampling.sample_uniform(rows, 10_000, "id")
    per = [r["count"] for r in out.groupBy("w").count().collect()]
    assert len(per) == 10 and all(abs(c - 1000) < 130 for c in per)


def test_weighted_sample_equals_a_global_sort(rows):
    u = hash_uniform(hash_key(["id"], 42))
    expected = rows.filter("w > 0").orderBy(-F.ln(u) / F.col("w"), "id").limit(800)
    assert ids(sampling.sample_weighted(rows, 800, "id", "w")) == ids(expected)


def test_weighted_sample_follows_the_weights(rows):
    out = sampling.sample_weighted(rows, 2000, "id", "w")
    per = {r["w"]: r["count"] for r in out.groupBy("w").count().collect()}
    assert 0.0 not in per
    for w in range(1, 10):
        expected = 2000 * w / 45
        assert abs(per[float(w)] - expected) < 5 * math.sqrt(expected)


def test_weighted_sample_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, 0.0), (3, None), (4, float("nan")), (5, 2.0)], "id int, w double"
    )
    assert ids(sampling.sample_weighted(df, 4, "id", "w")) == {1, 5}
    bad = spark.createDataFrame([(1, -1.0), (2, 1.0)], "id int, w double")
    with pytest.raises(Exception, match="negative sampling weight"):
        sampling.sample_weighted(bad, 1, "id", "w").collect()


def test_sample_with_a_hot_key_and_repeated_ids(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id")).alias("id")
    )
    for n in (10, 2999, 5000, 8999):
        assert sampling.sample_uniform(df, n, "id").count() == n


def test_compound_id(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("a"), F.floor(F.col("id") / 20).alias("b"))
    out = sampling.sample_uniform(df, 50, ["a", "b"])
    assert out.distinct().count() == 50


def test_folds(rows):
    folds = sampling.with_fold(rows, "id", 5).groupBy("fold").count()
    sizes = collect(folds, "fold")
    assert [r["fold"] for r in sizes] == [0, 1, 2, 3, 4]
    assert all(abs(r["count"] - 10_000) < 500 for r in sizes)
