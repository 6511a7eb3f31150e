"""Cross-product sums over the cells: the one distributed pass custom fits need.

Each task turns its batches of cells into a few sums, Spark adds the sums up, and
the driver receives a matrix whose size depends on the model alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows times columns a task works on at once.
CHUNK_ENTRIES = 2_000_000
# Groups whose sums travel in one row, and the doubles of group sums a task holds.
GROUP_BLOCK = 256
HELD_GROUP_SUMS = 8_000_000
_LOSS = -1


@dataclass(frozen=True)
class Layout:
    """How a coded cell becomes a design row.

    ``terms`` holds (column, width): width 0 is a numeric column, a positive width
    the number of dummies of a level number, and -1 a factor with a single level.
    Column 0 is the intercept; ``keep`` lists the columns after it that are used.
    ``centre`` holds (column, mean, deviation) of numeric columns to standardise.
    """

    terms: tuple[tuple[str, int], ...]
    keep: tuple[int, ...] | None = None
    centre: tuple[tuple[str, float, float], ...] = ()
    group: str | None = None
    slopes: tuple[str, ...] = ()
    slope_shift: tuple[float, ...] = ()
    slope_scale: tuple[float, ...] = ()

    @property
    def inputs(self) -> list[str]:
        names = [c for c, _ in self.terms] + list(self.slopes)
        return list(dict.fromkeys(names + ([self.group] if self.group else [])))

    @property
    def columns(self) -> int:
        """Design columns after the intercept, used or not."""
        return sum(max(w, 1) if w >= 0 else 0 for _, w in self.terms)

    @property
    def width(self) -> int:
        return 1 + (self.columns if self.keep is None else len(self.keep))

    def entries(self, pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        """Design rows as one (position, value) pair of arrays per term.

        A row has one entry per term however many dummies there are, so the work
        grows with the terms, not with the columns.
        """
        rows = len(pdf)
        kept = range(self.columns) if self.keep is None else self.keep
        place = np.full(self.columns, -1)
        place[list(kept)] = 1 + np.arange(len(kept))
        scaling = {c: (m, s) for c, m, s in self.centre}
        out = [(np.zeros(rows, dtype=int), np.ones(rows))]
        start = 0
        for column, width in self.terms:
            values = pdf[column].to_numpy(dtype=float)
            if width == 0:
                mean, deviation = scaling.get(column, (0.0, 1.0))
                if place[start] >= 0:
                    out.append((np.full(rows, place[start]), (values - mean) / deviation))
                start += 1
            elif width > 0:
                level = values.astype(int)
                # The baseline has the highest level number and no column.
                position = np.append(place[start : start + width], -1)[np.minimum(level, width)]
                out.append((np.maximum(position, 0), (position >= 0).astype(float)))
                start += width
        return out

    def grouped(self, pdf: pd.DataFrame) -> np.ndarray:
        """Random-effect design rows: intercept and scaled slopes."""
        parts = [np.ones((len(pdf), 1))]
        for c, m, s in zip(self.slopes, self.slope_shift, self.slope_scale):
            parts.append(((pdf[c].to_numpy(dtype=float) - m) / s)[:, None])
        return np.hstack(parts)

    def but(self, **changes) -> Layout:
        return replace(self, **changes)


@dataclass
class Sums:
    """``cross`` = X'WX, ``score`` = X'r, and per group Z'WZ, X'WZ and Z'r.

    The tilts are X't and Z't, where t is the change of the working weight along
    the linear predictor times the variance ``z'Kz`` of a row's group effect.
    """

    cross: np.ndarray
    score: np.ndarray
    log_likelihood: float
    tilt: np.ndarray
    group_cross: np.ndarray | None = None
    group_fixed: np.ndarray | None = None
    group_score: np.ndarray | None = None
    group_tilt: np.ndarray | None = None


def _weights(eta, n, s, family):
    """Working weight and its slope, residual and log-likelihood at a linear predictor."""
    if family == "gaussian":
        return n, np.zeros_like(n), s - n * eta, 0.0
    mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
    w = n * mu * (1.0 - mu)
    return w, w * (1.0 - 2.0 * mu), s - n * mu, float(np.sum(s * eta - n * np.logaddexp(0.0, eta)))


def _group_sums(entries, z, j, w, r, t, width):
    """Per group in the chunk: Z'WZ, X'WZ, Z'r and Z't, flattened side by side."""
    q = z.shape[1]
    ids, at = np.unique(j, return_inverse=True)
    fixed = np.zeros((len(ids), width, q))
    for position, value in entries:
        np.add.at(fixed, (at, position), (w * value)[:, None] * z)
    own = np.zeros((len(ids), q * q + 2 * q))
    pieces = [(z[:, :, None] * z[:, None, :] * w[:, None, None]).reshape(len(z), -1)]
    pieces += [z * r[:, None], z * t[:, None]]
    np.add.at(own, at, np.hstack(pieces))
    return ids, np.hstack([own[:, : q * q], fixed.reshape(len(ids), -1), own[:, q * q :]])


def _hold(held: dict[int, np.ndarray], ids: np.ndarray, sums: np.ndarray) -> None:
    """Adds the sums of groups, in order, to those of their blocks."""
    block = ids // GROUP_BLOCK
    cuts = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist(), len(ids)]
    for i, j in zip(cuts, cuts[1:]):
        b = int(block[i])
        if b not in held:
            held[b] = np.zeros((GROUP_BLOCK, sums.shape[1]))
        held[b][ids[i:j] - b * GROUP_BLOCK] += sums[i:j]


def _task(layout: Layout, family: str, beta, effects, spread):
    """Body of a task: cells in, partial sums out."""

    def frame(keys, values):
        return pd.DataFrame({"block": np.asarray(keys, dtype=np.int64), "sums": list(values)})

    def flushed(held):
        blocks = list(held)
        for at in range(0, len(blocks), 64):
            some = blocks[at : at + 64]
            yield frame(_LOSS - 1 - np.array(some), [held.pop(b).ravel() for b in some])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = layout.width
        total = np.zeros((width, width + 2))
        cells = total.ravel()
        loss = 0.0
        held: dict[int, np.ndarray] = {}
        step = max(1, CHUNK_ENTRIES // width)
        for batch in batches:
            for start in range(0, len(batch), step):
                pdf = batch.iloc[start : start + step]
                entries = layout.entries(pdf)
                n, s = pdf["_n"].to_numpy(dtype=float), pdf["_s"].to_numpy(dtype=float)
                t = np.zeros_like(n)
                if beta is None:
                    w, r = n, s
                else:
                    eta = sum(beta[position] * value for position, value in entries)
                    if layout.group:
                        z = layout.grouped(pdf)
                        j = pdf[layout.group].to_numpy(dtype=int)
                        eta = eta + np.sum(z * effects[j], axis=1)
                    w, slope, r, part = _weights(eta, n, s, family)
                    loss += part
                    if layout.group:
                        t = slope * np.einsum("ia,iab,ib->i", z, spread[j], z)
                for row, left in entries:
                    base = row * (width + 2)
                    for column, right in entries:
                        np.add.at(cells, base + column, w * left * right)
                    np.add.at(cells, base + width, left * r)
                    np.add.at(cells, base + width + 1, left * t)
                if layout.group and beta is not None:
                    ids, sums = _group_sums(entries, z, j, w, r, t, width)
                    _hold(held, ids, sums)
                    if len(held) * GROUP_BLOCK * sums.shape[1] > HELD_GROUP_SUMS:
                        yield from flushed(held)
        yield from flushed(held)
        yield frame(np.arange(width), total)
        yield frame([_LOSS], [np.array([loss])])

    return run


def accumulate(
    cells: DataFrame, layout: Layout, family: str = "gaussian", beta=None, effects=None, spread=None
) -> Sums:
    """Sums over all cells; without ``beta`` the plain weighted cross-products.

    ``effects`` and ``spread`` hold the group effects and their variances.
    """
    columns = [F.col(c).cast("double").alias(c) for c in layout.inputs]
    rows = (
        cells.select(*columns, "_n", "_s")
        .mapInPandas(_task(layout, family, beta, effects, spread), "block long, sums array<double>")
        .groupBy("block")
        .agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
        .collect()
    )
    p = layout.width
    out = Sums(np.zeros((p, p)), np.zeros(p), 0.0, np.zeros(p))
    if layout.group and effects is not None:
        groups, q = effects.shape
        out.group_cross = np.zeros((groups, q, q))
        out.group_fixed = np.zeros((groups, p, q))
        out.group_score = np.zeros((groups, q))
        out.group_tilt = np.zeros((groups, q))
    for row in rows:
        block, v = row["block"], row["sums"].toArray()
        if block >= 0:
            out.cross[block], out.score[block], out.tilt[block] = v[:-2], v[-2], v[-1]
        elif block == _LOSS:
            out.log_likelihood = float(v[0])
        else:
            first = (_LOSS - 1 - block) * GROUP_BLOCK
            own = slice(first, min(first + GROUP_BLOCK, groups))
            v = v.reshape(GROUP_BLOCK, -1)[: own.stop - first]
            out.group_cross[own] = v[:, : q * q].reshape(-1, q, q)
            out.group_fixed[own] = v[:, q * q : q * q + p * q].reshape(-1, p, q)
            out.group_score[own] = v[:, -2 * q : -q]
            out.group_tilt[own] = v[:, -q:]
    return out
