"""Reproducible samples of an exact size, without replacement.

A row's draw depends only on its id and the seed, never on partitioning, so the
same rows come back on any cluster and a larger sample contains a smaller one.
The cut-off is predicted from the number (or the weights) of the rows, so that one
scan writes little more than the sample.  The exact cut is then made on that small
table: no task has to merge the top ``n`` rows of every partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areacast.functions.stats import clean_double, fold_of, hash_key, hash_uniform
from areacast.operators.joins import as_list
from areacast.sources.shared import settle

# Weight classes per doubling.  Doubles span about 2,100 doublings, which bounds
# the table of classes the driver sees.
CLASSES = 64


def _margin(n: int) -> float:
    """Ten standard deviations of a count with mean ``n``, and a little more."""
    return 10.0 * math.sqrt(n) + 10.0


def _cut(df: DataFrame, n: int, bounds, order: list[str]) -> DataFrame:
    """The first ``n`` rows of ``df`` in ``order``.

    ``bounds(low, high)`` gives two filters that are expected to hold for at most
    ``low`` and at least ``high`` rows, all of them before the others in order.
    Whether they do is checked on the written candidates, and the bounds are moved
    apart if not, so that the result is always exact.
    """
    margin = _margin(n)
    while True:
        sure, maybe = bounds(n - margin, n + margin)
        candidates = settle(df if maybe is None else df.filter(maybe), "sample")
        found, certain = candidates.agg(F.count(F.lit(1)), F.count_if(sure)).first()
        if found >= n or maybe is None:
            break
        margin *= 8
    if found <= n:
        return candidates
    if certain > n:
        return candidates.orderBy(*order).limit(n)
    edge = candidates.filter(~sure).orderBy(*order).limit(n - certain)
    return candidates.filter(sure).unionByName(edge)


def _hex_below(fraction: float) -> str:
    """A hex string above about ``fraction`` of all md5 keys."""
    return f"{int(max(fraction, 0.0) * 2**52):013x}"


def sample_uniform(df: DataFrame, n: int, id, seed=42) -> DataFrame:
    """Exactly ``n`` rows, each equally likely: the smallest md5 of id and seed."""
    if n < 1:
        return df.limit(0)
    ids = as_list(id)
    total = df.count()
    if total <= n:
        return df

    def bounds(low, high):
        key = F.col("_md5")
        everything = high >= total
        return key < _hex_below(low / total), None if everything else key < _hex_below(high / total)

    keyed = df.withColumn("_md5", hash_key(ids, seed))
    return _cut(keyed, n, bounds, ["_md5", *ids]).drop("_md5")


def _rate(classes: list[tuple[int, int]], target: float, upper: bool) -> float:
    """Exponential time by which ``target`` rows are expected to have been drawn.

    Every weight is taken at the lower (upper) edge of its class, which makes the
    time late (early) rather than early (late).
    """
    weights = [(2.0 ** min((b + upper) / CLASSES, 1023.0), rows) for b, rows in classes]
    if target <= 0:
        return 0.0
    if target >= sum(rows for _, rows in weights):
        return math.inf
    low, high = -1075.0, 1075.0
    for _ in range(80):
        middle = (low + high) / 2
        drawn = sum(rows * -math.expm1(-min(w * 2.0 ** min(middle, 1000), 700.0)) for w, rows in weights)
        low, high = (middle, high) if drawn < target else (low, middle)
    return 2.0 ** min(low if upper else high, 1023.0)


def sample_weighted(df: DataFrame, n: int, id, weight: Column | str, seed=42) -> DataFrame:
    """Exactly ``n`` rows, drawn one after the other in proportion to a weight.

    Exponential keys ``-ln(u) / w`` have the law of sequential draws (Efraimidis
    and Spirakis, 2006).  Rows of zero or missing weight are never drawn; a
    negative weight fails the job.
    """
    if n < 1:
        return df.limit(0)
    ids = as_list(id)
    w = clean_double(F.col(weight) if isinstance(weight, str) else weight)
    checked = F.when(w < 0, F.raise_error(F.lit("negative sampling weight")).cast("double")).otherwise(w)
    positive = df.withColumn("_w", checked).filter(F.col("_w") > 0)
    kind = F.floor(F.log2("_w") * CLASSES).alias("class")
    counted = positive.groupBy(kind).agg(F.count(F.lit(1)).alias("rows")).collect()
    classes = [(r["class"], r["rows"]) for r in counted]
    if sum(rows for _, rows in classes) <= n:
        return positive.drop("_w")

    def bounds(low, high):
        key = F.col("_key")
        last = _rate(classes, high, upper=False)
        return key < _rate(classes, low, upper=True), None if math.isinf(last) else key < last

    u = hash_uniform(hash_key(ids, seed))
    keyed = positive.withColumn("_key", -F.ln(u) / F.col("_w"))
    return _cut(keyed, n, bounds, ["_key", *ids]).drop("_w", "_key")


def with_fold(df: DataFrame, id, folds: int, seed=42, out: str = "fold") -> DataFrame:
    """Assign cross-validation folds by respondent id."""
    return df.withColumn(out, fold_of(as_list(id), folds, seed))
