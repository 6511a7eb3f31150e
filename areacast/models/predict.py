"""Score a frame with a linear predictor written as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areacast.functions.stats import inverse_logit
from areacast.operators.joins import lookup_join

# Up to this many levels the coefficients ride in the plan as a literal map.
INLINE_LEVELS = 100


def _unseen(term: str, text: Column) -> Column:
    message = F.concat(F.lit(f"level of {term} not in the model: "), text)
    return F.raise_error(message).cast("double")


def _attach(frame: DataFrame, term: str, effects: Mapping[str, float], out: str, unseen: str):
    """Add column ``out`` with the effect of each row's level of ``term``."""
    text = F.col(term).cast("string")
    miss = F.lit(0.0) if unseen == "population" else _unseen(term, text)
    if len(effects) <= INLINE_LEVELS:
        pairs = [F.lit(v) for kv in effects.items() for v in (str(kv[0]), float(kv[1]))]
        hit = F.try_element_at(F.create_map(*pairs), text)
    else:
        # Longer lists become a table; its size is that of the model.
        rows = [(str(k), float(v)) for k, v in effects.items()]
        key, value = f"_k_{out}", f"_e_{out}"
        table = frame.sparkSession.createDataFrame(rows, f"`{key}` string, `{value}` double")
        frame = lookup_join(frame.withColumn(key, text), table, key).drop(key)
        hit = F.col(value)
    effect = F.when(text.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(hit, miss))
    frame = frame.withColumn(out, effect)
    return frame.drop(f"_e_{out}")


@dataclass(frozen=True)
class LinearPredictor:
    """Intercept, slopes, level effects and group effects on the original scale.

    ``groups`` maps a grouping column to ``{"": {level: intercept}, slope: {...}}``.
    """

    family: str
    intercept: float
    numeric: Mapping[str, float] = field(default_factory=dict)
    factors: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    groups: Mapping[str, Mapping[str, Mapping[str, float]]] = field(default_factory=dict)

    def score(
        self, frame: DataFrame, out: str = "predicted_probability", scale: str = "response",
        unseen: str = "error",
    ) -> DataFrame:
        """Append the prediction.

        A missing predictor gives a missing prediction.  An unseen factor level
        fails the job; an unseen *group* does too, unless
        ``unseen="population"`` gives it an effect of zero.
        """
        if scale not in ("response", "link"):
            raise ValueError("scale must be 'response' or 'link'")
        if unseen not in ("error", "population"):
            raise ValueError("unseen must be 'error' or 'population'")
        eta = F.lit(float(self.intercept))
        for name, slope in self.numeric.items():
            eta = eta + F.col(name).cast("double") * F.lit(float(slope))
        work = frame
        parts = []
        for i, (term, effects) in enumerate(self.factors.items()):
            part = f"_eta_{i}"
            work = _attach(work, term, effects, part, "error")
            parts.append(part)
            eta = eta + F.col(part)
        for g, (group, tables) in enumerate(self.groups.items()):
            for k, (slope, effects) in enumerate(tables.items()):
                part = f"_eta_g{g}_{k}"
                work = _attach(work, group, effects, part, unseen)
                parts.append(part)
                factor = F.col(slope).cast("double") if slope else F.lit(1.0)
                eta = eta + F.col(part) * factor
        if scale == "response" and self.family == "binomial":
            eta = inverse_logit(eta)
        return work.withColumn(out, eta).drop(*parts)
