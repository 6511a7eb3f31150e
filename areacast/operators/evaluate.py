"""Compare estimates with known area values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.functions import stats
from areacast.operators.joins import area_join, as_list
from areacast.operators.poststratify import with_interval


def join_truth(estimates: DataFrame, truth: DataFrame, area, how: str = "estimates") -> DataFrame:
    """Estimates beside the truth.

    ``how="estimates"`` keeps the areas that have an estimate; ``how="truth"``
    keeps every known area, with a missing estimate where there is none.
    """
    if how == "estimates":
        return area_join(estimates, truth, area)
    if how == "truth":
        return area_join(truth, estimates, area)
    raise ValueError("how must be 'estimates' or 'truth'")


def metrics(
    joined: DataFrame, estimate: str = "estimate", truth: str = "truth",
    na: str = "propagate", digits: tuple[int, int] | None = None,
) -> DataFrame:
    """One row: correlation and mean absolute error (optionally rounded)."""
    r = stats.pearson(F.col(estimate), F.col(truth), na)
    e = stats.mean_abs_error(F.col(estimate), F.col(truth), na)
    if digits is not None:
        r, e = F.round(r, digits[0]), F.round(e, digits[1])
    return joined.agg(r.alias("correlation"), e.alias("mean_abs_error"))


def compare_to_truth(
    estimates: DataFrame, truth: DataFrame, area, how: str = "estimates",
    estimate: str = "estimate", truth_column: str = "truth", na: str = "propagate",
    digits: tuple[int, int] | None = (2, 3),
) -> tuple[DataFrame, DataFrame]:
    """The joined table and its one-row summary."""
    joined = join_truth(
        estimates.select(*as_list(area), estimate), truth.select(*as_list(area), truth_column),
        area, how,
    )
    return joined, metrics(joined, estimate, truth_column, na, digits)


def with_caption(summary: DataFrame) -> DataFrame:
    """The summary with a line of text for a figure."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("NA"))

    line = F.concat(
        F.lit("Correlation = "), text("correlation"),
        F.lit(", Mean Absolute Error = "), text("mean_abs_error"),
    )
    return summary.withColumn("caption", line)


def caterpillar(
    target: DataFrame, sample: DataFrame, modelled: DataFrame, area,
    value: str = "pct_support", n: str = "num_respondents",
    sample_value: str = "estimate", model_value: str = "estimate",
) -> DataFrame:
    """Target with interval, sample mean and modelled estimate, ordered by target."""
    keys = as_list(area)
    out = with_interval(target.select(*keys, value, n), value, n)
    out = area_join(out, sample.select(*keys, F.col(sample_value).alias("sample_estimate")), keys)
    out = area_join(out, modelled.select(*keys, F.col(model_value).alias("model_estimate")), keys)
    return out.orderBy(value, *keys)


def ordered_areas(df: DataFrame, area, value: str) -> DataFrame:
    """Areas sorted by value, ties by area."""
    return df.orderBy(value, *as_list(area))
