"""Language ID with string kernels: presence of blended byte n-grams, Nystroem landmarks,
one-versus-rest kernel ridge regression.

``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)`` for the sets ``G`` of hashed n-grams of
1 to 4 bytes.  The regression is solved in the span of the landmarks.  A document's
scores are ``K(x, Z) W``; as ``K(x, Z)`` is itself the product of the presence row of
``x`` with the landmarks' rows, batches are scored with the product of both matrices,
``presence @ (landmarks.T @ W)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areacast.llm.text import mix, tidy, unused

GRAM_BITS = 16
ORDERS = (1, 2, 3, 4)


def gram_slots(text: str) -> np.ndarray:
    """Distinct slots of the text's byte n-grams, in order of their last occurrence."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.uint64)
    parts, packed = [], np.zeros(len(data), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if len(data) < order:
            break
        packed = (packed[: len(data) - order + 1] << np.uint64(8)) | data[order - 1 :]
        if order in ORDERS:
            parts.append(mix(packed + np.uint64(order << 40)) >> np.uint64(64 - GRAM_BITS))
    if not parts:
        return np.empty(0, np.int64)
    slots = np.concatenate(parts).astype(np.int64)
    last = np.empty(1 << GRAM_BITS, np.int64)
    place = np.arange(len(slots))
    last[slots] = place
    return slots[last[slots] == place]


@dataclass(frozen=True)
class LanguageModel:
    """Classes and, for each gram slot, the weight it adds to each class."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest scores: presence rows times the slots' weights."""
        slots = [gram_slots(t) for t in texts]
        sizes = np.array([len(s) for s in slots])
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.append(0, np.cumsum(sizes[some]))[:-1]
            present = self.weights[np.concatenate([slots[i] for i in some])]
            out[some] = np.add.reduceat(present, starts, axis=0)
            out[some] /= np.sqrt(sizes[some])[:, None]
        return out


def fit_languages(
    labelled: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = 2400,
    landmarks: int = 400,
    ridge: float = 1e-3,
    seed: int = 11,
) -> LanguageModel | None:
    """Fit on at most about ``sample`` labelled rows, spread evenly over the labels.

    The rows of a label are drawn by a seeded hash of the id, so the sample does not
    depend on partitions.  Rows without text or label are left out; without any
    labelled row there is no model (None).
    """
    usable = labelled.select(
        F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where(r"lang is not null and text rlike '\\p{L}'")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return None
    each = max(1, sample // len(counts))
    share = F.create_map(
        *(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * each / r["count"])))
    )
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 32))
    drawn = (
        usable.withColumn("place", place)
        .where(F.col("place") < F.element_at(share, F.col("lang")) * (1 << 32))
        .orderBy("place", "id")
        .limit(2 * sample)
        .select("text", "lang")
        .collect()
    )
    languages = tuple(sorted(r["lang"] for r in counts))
    held: dict[str, list[np.ndarray]] = {x: [] for x in languages}
    for row in drawn:
        if len(held[row["lang"]]) < each:
            held[row["lang"]].append(gram_slots(row["text"]))
    return _ridge(languages, held, landmarks, ridge)


def _ridge(languages, held, landmarks: int, ridge: float) -> LanguageModel:
    per_class = max(1, landmarks // len(languages))
    chosen = [g for x in languages for g in held[x][:per_class]]
    z = np.zeros((len(chosen), 1 << GRAM_BITS), np.float32)
    for i, grams in enumerate(chosen):
        z[i, grams] = 1 / np.sqrt(max(1, len(grams)))
    inner = (z @ z.T).astype(float)
    values, vectors = np.linalg.eigh(inner)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    gram = np.zeros((root.shape[1],) * 2)
    target = np.zeros((root.shape[1], len(languages)))
    n = 0
    for c, x in enumerate(languages):
        for at in range(0, len(held[x]), 64):
            part = held[x][at : at + 64]
            rows_ = np.zeros((len(part), 1 << GRAM_BITS), np.float32)
            for i, grams in enumerate(part):
                rows_[i, grams] = 1 / np.sqrt(max(1, len(grams)))
            features = (rows_ @ z.T).astype(float) @ root
            gram += features.T @ features
            y = np.full((len(part), len(languages)), -1.0)
            y[:, c] = 1
            target += features.T @ y
            n += len(part)
    solved = np.linalg.solve(gram + ridge * n * np.eye(len(gram)), target)
    return LanguageModel(languages, z.T @ (root @ solved).astype(np.float32))


def predict_languages(
    docs: DataFrame, model: LanguageModel | None, text: str = "text", raw: bool = False
) -> DataFrame:
    """``docs`` with ``lang_pred, lang_score`` added (or replaced) in every row.

    If ``raw``, the score is the best one-versus-rest score itself (learned as 1 for the
    text's language and -1 for others, 0 without known n-grams), whatever the number of labels.
    Otherwise:

    The score is the softmax share of the best one-versus-rest score.  A text that is
    missing or has no letter is ``und`` with score 0, and so is every text if there
    is no model; among equal scores the first label wins.  Each row stands for
    itself, and its other columns pass through; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("lang_score", "double")
    at, names = docs.columns.index(text), [*docs.columns, "lang_pred", "lang_score"]

    def run(batches: Iterator[pa.RecordBatch]):
        m: LanguageModel | None = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                *columns, has_letter = part.columns
                usable = [
                    t if h and m else None
                    for t, h in zip(columns[at].to_pylist(), has_letter.to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*columns, *_predicted(m, usable, raw)], names=names)

    return docs.withColumn(unused("lang_has_letter", docs), letters).mapInArrow(tidy(run), schema)


def _predicted(m: LanguageModel | None, texts: list[str | None], raw: bool = False) -> list[pa.Array]:
    some = [i for i, t in enumerate(texts) if t is not None]
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if some:
        s = 2 * m.scores([texts[i] for i in some])
        best = s.argmax(axis=1)
        score[some] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b in zip(some, best.tolist(), strict=True):
            lang[i] = m.languages[b]
        if raw:
            score[some] = s.max(axis=1) / 2
    score = score if raw else np.clip(score, 0, 1)
    return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
