"""Row filters of the cleaning step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areacast.operators.joins import as_list, lookup_join
from areacast.sources.shared import settle


def complete_cases(df: DataFrame, columns=None) -> DataFrame:
    """Drop rows with a missing value, NaN included, in any (listed) column.

    Written as null tests so that the scan can skip row groups.
    """
    names = df.columns if columns is None else as_list(columns)
    tests = []
    for name in names:
        c = F.col(f"`{name}`")
        tests.append(c.isNotNull())
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            tests.append(~F.isnan(c))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def areas_above(df: DataFrame, area, min_exclusive: int) -> DataFrame:
    """Areas with strictly more than ``min_exclusive`` rows, with their count."""
    keys = as_list(area)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > F.lit(min_exclusive))
    )


def keep_large_areas(
    df: DataFrame, area, min_exclusive: int, counts_from: DataFrame | None = None
) -> DataFrame:
    """Keep rows of the areas that pass ``areas_above`` on ``counts_from`` (or ``df``).

    The kept list is a small written table, so the counting pass (over the area
    column alone) runs once.  A missing area that passes is kept too.
    """
    counts = areas_above(df if counts_from is None else counts_from, area, min_exclusive)
    kept = settle(counts.select(*as_list(area)), "kept")
    return lookup_join(df, kept, area, how="left_semi", null_safe=True)
