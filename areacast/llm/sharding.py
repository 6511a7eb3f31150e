"""Sharding by vector bin packing: bytes, tokens and rows balanced together."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areacast.llm.text import utf8_bytes, word_count

#: Cells that groups of equal texts fall into by hash.  Cells are packed, so what the
#: driver holds does not depend on the data.
CELLS = 4096
#: A group with more than this part of all bytes, tokens or rows is split into such parts.
HEAVY = 1 / 1024


def place_units(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit: largest first, where residual capacity and load point alike.

    ``loads`` has a row for each unit and a column for each quantity.  Units go to
    the shard with the highest dot product of load and residual capacity, shards
    that have room in every quantity first.
    """
    total = loads.sum(axis=0)
    loads = loads / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int64)
    for u in np.argsort(-loads.max(axis=1), kind="stable"):
        fits = (residual >= loads[u] - 1e-12).all(axis=1)
        score = residual @ loads[u]
        out[u] = np.argmax(np.where(fits, score + 1e6, score))
        residual[out[u]] -= loads[u]
    return out


def shard_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 16
) -> DataFrame:
    """``id, size, n_tokens, text_crc32, shard, slot`` for every row of ``docs``.

    The size is the text's UTF-8 bytes plus 1.  Equal texts fall into one cell and
    share a shard, unless they hold over ``HEAVY`` of all bytes, tokens or rows (as many
    missing texts do): such a group is split by id.  ``slot`` numbers the rows of a shard from 0 without gaps.  A missing text
    counts as empty; rows without id and repeated rows are rows like others; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("id"),
        (utf8_bytes(t) + 1).alias("size"),
        word_count(t).alias("n_tokens"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.md5(t.cast("binary")).alias("group"),
    )
    sums = [F.sum("size"), F.sum("n_tokens"), F.count("*")]
    totals = [F.lit(max(v or 0, 1)) for v in rows.agg(*sums).first()]
    share = F.greatest(*(part / whole for part, whole in zip(sums, totals, strict=True)))
    heavy = (
        rows.groupBy("group").agg(share.alias("share")).where(F.col("share") > HEAVY)
    ).collect()  # fewer than 3 / HEAVY rows
    base = CELLS
    parts = []
    for group, part in sorted(heavy):
        n = math.ceil(part / HEAVY)
        parts.append((group, base, n))
        base += n
    split = F.broadcast(spark.createDataFrame(parts, "group string, base long, parts long"))
    cell = F.pmod(F.xxhash64("group"), F.lit(CELLS))
    unit = F.coalesce(F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts")), cell)
    rows = rows.join(split, "group", "left").select(
        "id", "size", "n_tokens", "text_crc32", unit.alias("unit")
    )
    units = sorted(
        rows.groupBy("unit")
        .agg(*sums)
        .collect()  # at most CELLS + 6 / HEAVY rows
    )
    loads = np.array([tuple(u)[1:] for u in units], float).reshape(-1, 3)
    placed = place_units(loads, shards)
    first, offsets = np.zeros(shards, np.int64), []
    for row, s in zip(units, placed, strict=True):
        offsets.append((row["unit"], int(s), int(first[s])))
        first[s] += row[3]
    plan = F.broadcast(spark.createDataFrame(offsets, "unit long, shard int, offset long"))
    within = F.row_number().over(W.partitionBy("unit").orderBy("id", "size", "text_crc32")) - 1
    return rows.withColumn("within", within).join(plan, "unit").select(
        F.col("id").alias(id),
        "size",
        "n_tokens",
        "text_crc32",
        "shard",
        (F.col("offset") + F.col("within")).alias("slot"),
    )
