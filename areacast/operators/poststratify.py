"""Area means, sample disaggregation and poststratified estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areacast.functions import stats
from areacast.operators.joins import as_list


def area_mean(
    df: DataFrame, area, value: str, weight: str | None = None, out: str = "truth",
    na: str = "propagate",
) -> DataFrame:
    """Mean of ``value`` in each area."""
    m = (
        stats.mean(F.col(value), na)
        if weight is None
        else stats.weighted_mean(F.col(value), F.col(weight), na)
    )
    return df.groupBy(*as_list(area)).agg(m.alias(out))


def disaggregate(
    df: DataFrame, area, value: str, weight: str | None = None, out: str = "estimate",
    num: str = "num", na: str = "propagate",
) -> DataFrame:
    """Mean of ``value`` and number of respondents in each area."""
    if weight is None:
        m, n = stats.mean(F.col(value), na), F.count(F.lit(1))
    else:
        m, n = stats.weighted_mean(F.col(value), F.col(weight), na), F.sum(weight)
    return df.groupBy(*as_list(area)).agg(m.alias(out), n.alias(num))


def with_interval(
    df: DataFrame, p: str, n: str, low: str = "conf_low", high: str = "conf_high",
    z: float = stats.Z95_ROUNDED,
) -> DataFrame:
    """Add the normal-approximation interval of a proportion."""
    lo, hi = stats.interval(F.col(p), F.col(n), z)
    return df.withColumns({low: lo, high: hi})


def poststratify(
    frame: DataFrame, area, value: str = "predicted_probability", weight: str = "n",
    out: str = "estimate", na: str = "propagate",
) -> DataFrame:
    """Weighted mean of the scored cells of each area; the weight is n or a share."""
    return frame.groupBy(*as_list(area)).agg(
        stats.weighted_mean(F.col(value), F.col(weight), na).alias(out)
    )


def group_line(df: DataFrame, group, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` in each group: intercept and slope."""
    a, b = stats.clean_double(F.col(x)), stats.clean_double(F.col(y))
    if weight is None:
        aggs = [F.regr_intercept(b, a).alias("intercept"), F.regr_slope(b, a).alias("slope")]
        return df.groupBy(*as_list(group)).agg(*aggs)
    w = F.when(a.isNotNull() & b.isNotNull(), F.col(weight).cast("double"))
    sums = df.groupBy(*as_list(group)).agg(
        F.sum(w).alias("_w"),
        F.sum(w * a).alias("_wx"),
        F.sum(w * b).alias("_wy"),
        F.sum(w * a * a).alias("_wxx"),
        F.sum(w * a * b).alias("_wxy"),
    )
    mx, my = F.try_divide("_wx", "_w"), F.try_divide("_wy", "_w")
    slope = F.try_divide(
        F.col("_wxy") - F.col("_wx") * my, F.col("_wxx") - F.col("_wx") * mx
    )
    return sums.select(
        *as_list(group), (my - slope * mx).alias("intercept"), slope.alias("slope")
    )
