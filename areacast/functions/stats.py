"""Statistical expressions with explicit rules for missing values.

``na="propagate"`` makes a statistic missing as soon as one of its inputs is;
``na="skip"`` leaves incomplete inputs out, weight included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 97.5% point of the standard normal, as rounded in the published intervals.
Z95_ROUNDED = 1.96
# The same point to double precision, for model coefficients.
Z95 = 1.959963984540054


def _check(na: str) -> bool:
    if na not in ("propagate", "skip"):
        raise ValueError("na must be 'propagate' or 'skip'")
    return na == "skip"


def clean_double(c: Column) -> Column:
    """Double with NaN turned into null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def mean(value: Column, na: str = "propagate") -> Column:
    """Unweighted mean."""
    skip = _check(na)
    v = clean_double(value)
    if skip:
        return F.avg(v)
    return F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))


def weighted_mean(value: Column, weight: Column, na: str = "propagate") -> Column:
    """Weighted mean; rows of zero weight never matter, zero total weight is missing."""
    skip = _check(na)
    v, w = clean_double(value), clean_double(weight)
    complete = v.isNotNull() & w.isNotNull()
    ratio = F.try_divide(
        F.sum(F.when(complete & (w != 0), v * w)), F.sum(F.when(complete, w))
    )
    if skip:
        return ratio
    spoiled = F.coalesce(w != 0, F.lit(True)) & ~complete
    return F.when(F.max(spoiled.cast("int")) == 0, ratio)


def mean_abs_error(estimate: Column, truth: Column, na: str = "propagate") -> Column:
    return mean(F.abs(clean_double(estimate) - clean_double(truth)), na)


def pearson(x: Column, y: Column, na: str = "propagate") -> Column:
    """Pearson correlation; missing when either side is constant."""
    skip = _check(na)
    a, b = clean_double(x), clean_double(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    if skip:
        return r
    return F.when(F.count(a) == F.count(F.lit(1)), r)


def interval(p: Column, n: Column, z: float = Z95_ROUNDED) -> tuple[Column, Column]:
    """Normal-approximation interval of a proportion: ``p -/+ z sqrt(p(1-p)/n)``."""
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")))
    return p - half, p + half


def inverse_logit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def logit(p: Column) -> Column:
    return F.ln(F.try_divide(p, 1 - p))


def hash_key(ids: list[str], seed) -> Column:
    """md5 of the row id and a seed: the same for any partitioning or engine."""
    parts = [F.col(c).cast("string") for c in ids] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(key: Column) -> Column:
    """Uniform number in (0, 1) from the first 52 bits of an md5 key."""
    bits = F.conv(F.substring(key, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def fold_of(ids: list[str], folds: int, seed) -> Column:
    """Cross-validation fold 0..folds-1 of a row, keyed by its id."""
    bits = F.conv(F.substring(hash_key(ids, f"fold:{seed}"), 1, 13), 16, 10).cast("long")
    return F.pmod(bits, F.lit(folds)).cast("int")
