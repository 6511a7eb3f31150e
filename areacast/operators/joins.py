"""Lookups that stay fast with a hot key and safe with a large lookup side."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot above 1/HOT_FRACTION of the rows, so there are fewer than this many.
HOT_FRACTION = 1000
HASH_BUCKETS = 16_384
# By how much a table may grow when it is read: files are compressed.
READ_GROWTH = 256
SPREAD = 64


def as_list(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's own size estimate of the optimized plan, if this session shows it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except (AttributeError, PySparkException, Py4JError, ValueError):
        return None


def fits_in_broadcast(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Whether a table may be broadcast.

    The statistics of its optimized plan decide where they are clear, which takes no job:
    Spark's estimate never falls short of the files it reads, so an estimate so small that
    even ``READ_GROWTH`` times as much fits is enough.  Else the table is measured, by one
    aggregate over it.
    """
    estimate = estimated_bytes(df)
    if estimate is not None and estimate * READ_GROWTH <= max_bytes and estimate <= max_rows:
        return True
    fixed = 0
    width = F.lit(0).cast("long")
    for field in df.schema:
        if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            fixed += 16
        else:
            text = F.col(f"`{field.name}`").cast("string")
            width = width + F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width + F.lit(fixed))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that hold more than 1/HOT_FRACTION of the rows; few by construction.

    Rows are first counted by a hash of the key, which shuffles next to nothing.
    Keys are counted only inside buckets large enough to hide a hot one.
    """
    on = as_list(on)
    bucket = F.pmod(F.xxhash64(*on), F.lit(HASH_BUCKETS))
    sizes = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit = sum(r["n"] for r in sizes) / HOT_FRACTION
    suspects = [r["b"] for r in sizes if r["n"] > limit]
    empty = df.select(*on).schema
    if not suspects:
        return df.sparkSession.createDataFrame([], empty)
    counts = df.filter(bucket.isin(suspects)).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    kept = counts.filter(F.col("_rows") > limit).select(*on)
    return df.sparkSession.createDataFrame(kept.collect(), empty)


def _spread_hot_keys(left, right, keys, renamed):
    """Salt only the hot keys: their left rows spread out, their right rows repeat.

    Returns the two sides, salted or, without any hot key, as they came.  The salt
    is the number of the input partition: it reads no column, and a task that runs
    again gives its rows the same salt.
    """
    hot = hot_keys(left, keys)
    if not hot.head(1):
        return left, right, False
    flags = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))

    def flagged(df, names):
        same = [F.col(n).eqNullSafe(F.col(f"_h_{k}")) for n, k in zip(names, keys)]
        # At most HOT_FRACTION rows, by construction.
        joined = df.join(F.broadcast(flags), same, "left")
        return joined.drop(*[f"_h_{k}" for k in keys])

    salt = F.pmod(F.spark_partition_id(), F.lit(SPREAD))
    left = flagged(left, keys).withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = flagged(right, renamed).withColumn("_r_salt", F.explode(copies))
    return left.drop("_hot"), right.drop("_hot"), True


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on,
    how: str = "left",
    null_safe: bool = False,
    small: bool = True,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join a large ``left`` to a lookup table that is usually small.

    The lookup side is measured first.  Within the bound it is broadcast and the
    left side never moves.  Beyond it both sides shuffle by key, with the hot
    keys of the left side spread over several tasks.  Results are the same.

    ``small=False`` skips the measurement for a side known to be large, which
    would have to be computed just to be measured.  ``null_safe`` lets a missing
    key match a missing key.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError("how must be left, inner or left_semi")
    keys = as_list(on)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if how != "left_semi" and clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    if how == "left_semi":
        right = right.select(*keys)
    columns = list(left.columns)
    extra = [c for c in right.columns if c not in keys]
    renamed = [f"_r_{k}" for k in keys]
    right = right.select(
        *[F.col(f"`{k}`").alias(r) for k, r in zip(keys, renamed)], *[F.col(f"`{c}`") for c in extra]
    )
    match = [
        F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r)
        for k, r in zip(keys, renamed)
    ]
    if small and fits_in_broadcast(right, max_rows, max_bytes):
        joined = left.join(F.broadcast(right), match, how)
    else:
        left, right, salted = _spread_hot_keys(left, right, keys, renamed)
        if salted:
            match.append(F.col("_salt") == F.col("_r_salt"))
        joined = left.join(right, match, how)
    if how == "left_semi":
        extra = []
    return joined.select(*[F.col(f"`{c}`") for c in columns + extra])


def natural_left_join(left: DataFrame, right: DataFrame, **kwargs) -> DataFrame:
    """Left join on every column the two tables share."""
    on = [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError("the tables share no column")
    return lookup_join(left, right, on, **kwargs)


def unique_by(df: DataFrame, keys) -> DataFrame:
    """Guard a lookup table: more than one row for a key fails the job."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in rest]
    )
    message = F.concat(
        F.lit(f"more than one row for {', '.join(keys)} = "),
        F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]),
    )
    return grouped.select(
        *keys,
        *[
            F.when(F.col("_rows") == 1, F.col(c))
            .otherwise(F.raise_error(message).cast(df.schema[c].dataType))
            .alias(c)
            for c in rest
        ],
    )


def area_join(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join two tables that both hold one row per key; missing matches missing.

    Neither side can have a hot key, so the choice of strategy is left to Spark.
    """
    keys = as_list(on)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    extra = [c for c in right.columns if c not in keys]
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys], *[F.col(f"`{c}`") for c in extra]
    )
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])
