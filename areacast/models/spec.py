"""What to fit, and the weighted cells it is fitted on."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areacast.operators.filters import complete_cases

FAMILIES = ("binomial", "gaussian")


@dataclass(frozen=True)
class ModelSpec:
    """Outcome, fixed terms and random terms of a model.

    ``random`` holds ``(group, (slope, ...))`` pairs: a random intercept per
    group with correlated random slopes.  A slope is not added to ``fixed`` by
    itself.  Text terms are factors whose baseline is the alphabetically first
    level; ``levels`` declares another order, or makes a numeric term a factor.
    """

    outcome: str
    fixed: Sequence[str] = ()
    random: Sequence[tuple[str, Sequence[str]]] = ()
    family: str = "binomial"
    weight: str | None = None
    levels: Mapping[str, Sequence] = field(default_factory=dict)

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"family must be one of {FAMILIES}")
        object.__setattr__(self, "fixed", tuple(self.fixed))
        object.__setattr__(self, "random", tuple((g, tuple(s)) for g, s in self.random))

    @property
    def columns(self) -> list[str]:
        """All predictor columns, each once."""
        names = list(self.fixed)
        for group, slopes in self.random:
            names += [group, *slopes]
        return list(dict.fromkeys(names))

    def but(self, **changes) -> ModelSpec:
        return replace(self, **changes)


class NotConverged(UserWarning):
    """A fit stopped at its number of passes; its estimates are those of the last one."""


def report(converged: bool, model: str, passes: int) -> None:
    if not converged:
        warnings.warn(f"{model} did not converge in {passes} passes", NotConverged, stacklevel=3)


def is_factor(schema: T.StructType, column: str, spec: ModelSpec) -> bool:
    kind = schema[column].dataType
    return column in spec.levels or not isinstance(kind, T.NumericType)


def collapse(df: DataFrame, spec: ModelSpec, extra: Sequence[str] = ()) -> DataFrame:
    """Complete rows reduced to distinct predictor cells.

    ``_n`` is the number (or weight) of respondents, ``_s`` and ``_q`` the sums of
    the outcome and of its square.  The likelihood depends on nothing else, so a
    fit on cells equals a fit on rows.  Partial aggregation does the reduction
    before the shuffle, whatever the share of the largest cell.
    """
    y = F.col(spec.outcome).cast("double")
    w = F.lit(1.0) if spec.weight is None else F.col(spec.weight).cast("double")
    needed = [*spec.columns, spec.outcome, *([spec.weight] if spec.weight else [])]
    rows = complete_cases(df, list(dict.fromkeys(needed)))
    if spec.weight is not None:
        rows = rows.filter(w != 0)
    if spec.family == "binomial":
        y = F.when(y.between(0, 1), y).otherwise(
            F.raise_error(F.lit(f"{spec.outcome} must lie in [0, 1]")).cast("double")
        )
    return rows.groupBy(*spec.columns, *extra).agg(
        F.sum(w).alias("_n"), F.sum(w * y).alias("_s"), F.sum(w * y * y).alias("_q")
    )
