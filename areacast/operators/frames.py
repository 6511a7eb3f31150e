"""Poststratification frames, shares, marginals and synthetic frames.

Counts are always taken before anything else happens to the rows.  Partial
aggregation then shrinks a hot area to its distinct cells on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areacast.operators.joins import as_list, lookup_join
from areacast.sources.shared import settle


def _size(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(F.col(weight))


def _constant(column: str) -> Column:
    """The one value of ``column`` in a group; fails the job if there are two."""
    present = F.count(F.col(column))
    same = F.min(column).eqNullSafe(F.max(column)) & present.isin(0, F.count(F.lit(1)))
    return F.when(same, F.min(column)).otherwise(
        F.raise_error(F.lit(f"{column} is not constant within a cell"))
    )


def psframe(df: DataFrame, area, predictors, weight: str | None = None, attributes=()) -> DataFrame:
    """Count every distinct combination of area and predictors.

    ``attributes`` (area constants such as a division or a vote share) give the
    rows of a count over all columns.  Numeric ones ride along as aggregates, which
    keeps floating-point numbers out of the shuffle key; text ones join the key,
    because aggregating text would force a sort of all rows.  ``weight`` sums a
    weight in place of counting rows.
    """
    keys = as_list(area) + as_list(predictors)
    attrs = as_list(attributes)
    riding = [a for a in attrs if isinstance(df.schema[a].dataType, T.NumericType)]
    counted = df.groupBy(*keys, *[a for a in attrs if a not in riding]).agg(
        *[_constant(a).cast(df.schema[a].dataType).alias(a) for a in riding],
        _size(weight).alias("n"),
    )
    return counted.select(*keys, *attrs, "n")


def shares(counts: DataFrame, by, n: str = "n", out: str = "prob") -> DataFrame:
    """Each row's share of its ``by`` total.

    Totals are aggregated and looked up, not windowed: a window would put all
    cells of a hot area into one task.  ``counts`` should be a settled or source
    table, because it is read twice.
    """
    keys = as_list(by)
    totals = counts.groupBy(*keys).agg(F.sum(n).cast("double").alias("_total"))
    joined = lookup_join(counts, totals, keys, null_safe=True)
    return joined.withColumn(out, F.try_divide(F.col(n), F.col("_total"))).drop("_total")


def cell_share(
    df: DataFrame, area, predictors, weight: str | None = None, attributes=(), out: str = "prob"
) -> DataFrame:
    """Poststratification frame with the share of each cell in its area."""
    frame = settle(psframe(df, area, predictors, weight, attributes), "frame")
    return shares(frame, area, "n", out)


def share_of_totals(counts: DataFrame, totals: DataFrame, n: str, total: str, out: str) -> DataFrame:
    """Share from an explicit table of totals, joined on all shared columns."""
    on = [c for c in counts.columns if c in totals.columns]
    if not on:
        raise ValueError("counts and totals share no column")
    joined = lookup_join(counts, totals, on, null_safe=True)
    return joined.withColumn(out, F.try_divide(F.col(n).cast("double"), F.col(total)))


def marginals_long(df: DataFrame, area, variables, weight: str | None = None) -> DataFrame:
    """All marginal distributions at once: area, variable, level, n, share.

    Grouping sets, one per variable: every task counts (area, level) pairs of each
    variable before it sends any, so what is shuffled is bounded by the tasks times the
    levels, whatever the number of joint cells.
    """
    keys, variables = as_list(area), as_list(variables)
    grouped = df.groupingSets([[*keys, v] for v in variables], *keys, *variables).agg(
        _size(weight).alias("n"), *[F.grouping(v).alias(f"_out_{v}") for v in variables]
    )
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v in reversed(variables):
        own = F.col(f"_out_{v}") == 0
        name = F.when(own, F.lit(v)).otherwise(name)
        level = F.when(own, F.col(v).cast("string")).otherwise(level)
    cells = grouped.select(*keys, name.alias("variable"), level.alias("level"), "n")
    return shares(settle(cells, "marginals"), keys + ["variable"], "n", "share")


def split_marginals(long: DataFrame, area, kinds: Mapping[str, T.DataType]) -> dict[str, DataFrame]:
    """One ``area, v, marginal_v`` table per variable, ready to be joined."""
    keys = as_list(area)
    return {
        v: long.filter(F.col("variable") == v).select(
            *keys, F.col("level").cast(kind).alias(v), F.col("share").alias(f"marginal_{v}")
        )
        for v, kind in kinds.items()
    }


def marginal(df: DataFrame, area, variable: str, weight: str | None = None) -> DataFrame:
    """Distribution of one variable within each area: ``n`` and ``marginal_<variable>``."""
    counts = settle(psframe(df, area, [variable], weight), "marginal")
    return shares(counts, area, "n", f"marginal_{variable}")


def marginals(df: DataFrame, area, variables, weight: str | None = None) -> dict[str, DataFrame]:
    """The marginal table of each variable, from one pass over the data."""
    kinds = {v: df.schema[v].dataType for v in as_list(variables)}
    # Each variable's table is looked up on its own; a written table has a known size.
    long = settle(marginals_long(df, area, variables, weight), "marginals")
    return split_marginals(long, area, kinds)


def synthetic_frame(
    shares_: DataFrame, tables: Mapping[str, DataFrame], area, prob: str = "prob"
) -> DataFrame:
    """Cross each cell with the levels of every marginal of its own area.

    The weight of a new cell is the product of the shares.  The expansion stays
    lazy: score and average it in the same job and it is never stored.
    """
    frame = shares_.drop("n")
    weight = F.col(prob)
    extra = []
    for v, table in tables.items():
        frame = lookup_join(frame, table.drop("n"), area, null_safe=True)
        weight = weight * F.col(f"marginal_{v}")
        extra.append(f"marginal_{v}")
    return frame.withColumn(prob, weight).drop(*extra)
