"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areacast.llm.text import unused, word_count
from areacast.operators.joins import lookup_join
from areacast.sources.shared import settle

#: Slices of the hash range whose sizes fix where the fractional repetition stops.
SLICES = 4096
_RANGE = 1 << 40


def _place(id: str, seed: int) -> Column:
    """A seeded place in [0, 1) that depends on the id alone: 40 bits of a digest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    digits = F.substring(F.md5(name.cast("binary")), 1, 10)
    return F.conv(digits, 16, 10).cast("double") / _RANGE


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size, weight``.

    The total size is shared in proportion to the weights.  A source whose share
    exceeds ``max_epochs`` times its size is clamped there and the excess shared by
    weight among the others until none is above: in the order of cap over weight,
    the clamped sources are those whose cap is at most their share of what is left.
    """
    cap = (F.col("source_size") * max_epochs).cast("double")
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = sizes.withColumn("cap", cap).select(
        "*",
        (
            (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(onward)
        ).alias("level"),
        F.row_number().over(order).alias("n"),
    )
    free = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct("n", "level"))
    return ranked.withColumn("at", F.min(free).over(W.partitionBy())).select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("weight") * F.col("at")["level"], F.col("cap"))).alias("target"),
    )


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Weights repeating over the sources in code-point order, the missing one last."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*(F.lit(float(w)) for w in weights))
    return sizes.withColumn("weight", F.get(values, n % len(weights)))


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=cyclic_weights,
    max_epochs: int = 3,
    seed: int = 20,
) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_repeats`` added.

    The size of a document is its number of words.  Every document of a source is
    repeated ``floor(target / source_size)`` times; the fraction left is met by one
    more repetition of the documents below a cut in a seeded order by id, which is
    placed by the sizes of ``SLICES`` slices of that order, so it is met up to the
    documents of one slice.  The missing source is a source; a missing text has size
    0; rows with equal ids are drawn together; a source without words has target 0;
    an empty table stays empty.  Columns of ``docs`` stay as they are, but for those
    that have the name of an added one, which it replaces.
    """
    added = ("mix_size", "mix_source_size", "mix_target", "mix_repeats")
    docs = docs.drop(*added)
    place, key = unused("mix_place", docs), unused("mix_source", docs)
    sized = docs.withColumns({"mix_size": word_count(F.col(text)), place: _place(id, seed)})
    slices = sized.groupBy(
        F.col(source).alias("source"),
        F.floor(F.col(place) * SLICES).cast("int").alias("slice"),
    ).agg(F.sum("mix_size").alias("slice_size"))
    # One row a source and slice, counted once for all that follows.
    slices = settle(slices, "mix_slices")
    per_source = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(weights(per_source), max_epochs)
    times = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    need = (times - F.floor(times)) * F.col("source_size")
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    reached = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(run), F.lit(0)))
    stop = (
        reached.join(
            targets.select(F.col("source").alias("s"), need.alias("need")),
            F.col("source").eqNullSafe(F.col("s")),
        )
        .where((F.col("before") <= F.col("need")) & (F.col("slice_size") > 0))
        .groupBy("source")
        .agg(
            F.max(
                F.struct(
                    "slice",
                    F.least(
                        (F.col("need") - F.col("before")) / F.col("slice_size"), F.lit(1.0)
                    ).alias("part"),
                )
            ).alias("last")
        )
        .select(
            F.col("source").alias("s"),
            ((F.col("last")["slice"] + F.col("last")["part"]) / SLICES).alias("cut"),
        )
    )
    whole, cut = unused("mix_whole", docs), unused("mix_cut", docs)
    plan = targets.join(stop, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias(key),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.floor(times).cast("int").alias(whole),
        F.coalesce("cut", F.lit(0.0)).alias(cut),
    )
    # One row a source: broadcast by its size, or joined with the hot sources spread.
    keyed = sized.withColumn(key, F.col(source))
    known = lookup_join(keyed, settle(plan, "mix_plan"), key, null_safe=True)
    repeats = F.col(whole) + (F.col(place) < F.col(cut)).cast("int")
    return known.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *added[:3],
        F.least(repeats, F.lit(max_epochs)).alias("mix_repeats"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each repetition; documents taken 0 times are left out."""
    times = F.explode(F.array_repeat(F.lit(1), F.col("mix_repeats")))
    copy = unused("mix_copy", mixed)
    return mixed.withColumn(copy, times).drop(copy)
