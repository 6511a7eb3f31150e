"""Area covariates: long to wide, shares, and attaching them to a survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areacast.operators.joins import as_list, lookup_join, unique_by
from areacast.sources.shared import settle


def pivot_wider(df: DataFrame, id_cols, names_from: str, values_from: str, names) -> DataFrame:
    """One column per listed name; two rows for one (id, name) fail the job.

    The names are given, so there is one shuffle and no pass to discover them.
    """
    ids = as_list(id_cols)
    names = list(names)
    hits = {n: F.col(names_from) == F.lit(n) for n in names}
    wide = (
        df.filter(F.col(names_from).isin(*names))
        .groupBy(*ids)
        .agg(
            *[F.max(F.when(hits[n], F.col(values_from))).alias(n) for n in names],
            *[F.count_if(hits[n]).alias(f"_rows_{i}") for i, n in enumerate(names)],
        )
    )
    kind = df.schema[values_from].dataType
    return wide.select(
        *ids,
        *[
            F.when(F.col(f"_rows_{i}") <= 1, F.col(n))
            .otherwise(F.raise_error(F.lit(f"more than one row for {n}")).cast(kind))
            .alias(n)
            for i, n in enumerate(names)
        ],
    )


def two_party_share(first: Column, second: Column) -> Column:
    """First party's percentage of the two-party vote."""
    a, b = first.cast("double"), second.cast("double")
    return F.try_divide(a, a + b) * 100


def attach_covariates(df: DataFrame, on, *tables: DataFrame, null_safe: bool = True) -> DataFrame:
    """Left join one-row-per-area tables; a repeated area fails the job.

    Each table is computed and checked once, however large what it comes from.
    """
    for table in tables:
        lookup = settle(unique_by(table, on), "lookup")
        df = lookup_join(df, lookup, on, null_safe=null_safe)
    return df
