"""Exact top-k by inner product: blocks in the order of their bounds for each query.

Vectors are cut into blocks of neighbours by id.  A block's forward index is its
matrix; its bound for a query is the sum over terms of the larger product with the
block's maximum and minimum of the term.  A query scores blocks from the highest bound
down, until the bound falls below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256
#: Blocks that each query scores between two looks at its k-th score.
ROUND = 8
#: Vectors and queries that meet in one task; more of either make more tasks.
VECTORS, QUERIES = 65_536, 4_096


def block_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bound of each block for each query, from the blocks' term maxima and minima."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ high.T + down @ low.T


def search_blocks(
    q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, vector, score`` of each query's ``k`` best among ``v``, itself left out."""
    order = np.argsort(v_id, kind="stable")
    v_id, v = v_id[order], v[order]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64
    q, v = q.astype(kind), v.astype(kind)
    starts = np.arange(0, len(v), BLOCK)
    bounds = block_bounds(
        q, np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0)
    )
    ranked = np.argsort(-bounds, axis=1, kind="stable")
    best = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in q]
    bar = np.full(len(q), -np.inf)
    for at in range(0, len(starts), ROUND):
        blocks = ranked[:, at : at + ROUND]
        open_ = np.take_along_axis(bounds, blocks, 1) >= bar[:, None]
        if not open_.any():
            break
        who, col = np.nonzero(open_)
        which = blocks[who, col]
        by_block = np.argsort(which, kind="stable")
        who, which = who[by_block], which[by_block]
        cuts = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
        for a, z in zip(cuts, cuts[1:], strict=False):
            first = starts[which[a]]
            ids = v_id[first : first + BLOCK]
            scores = q[who[a:z]] @ v[first : first + BLOCK].T
            for row, i in zip(scores, who[a:z], strict=True):
                good = np.flatnonzero((row >= bar[i]) & (ids != q_id[i]))
                if len(good):
                    all_ids = np.append(best[i][0], ids[good])
                    all_scores = np.append(best[i][1], row[good])
                    top = np.lexsort((all_ids, -all_scores))[:k]
                    best[i] = (all_ids[top], all_scores[top])
                    if len(top) == k:
                        bar[i] = all_scores[top[-1]]
    sizes = [len(b[0]) for b in best]
    return (
        np.repeat(q_id, sizes),
        np.concatenate([b[0] for b in best]),
        np.concatenate([b[1] for b in best]).astype(np.int64),
    )


def scaled(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null if any is missing or not finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    )
    return F.when(~bad, F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best of ``vectors`` for each of ``queries``.

    Both have an id and an array of integers.  Scores are exact inner products; ties go
    to the smaller id; rows with the query's own id are not found.  Missing vectors
    or ids take no part; vectors meet only if they are equally long; a query with
    fewer partners gets fewer rows; repeated rows are found repeatedly; of queries that
    share an id the smallest vector is asked.  Queries and vectors meet in blocks of bounded size.
    """

    def tidy(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        return df.select(F.col(id).cast("long").alias("id"), v.alias("v")).where(
            "id is not null and v is not null and size(v) > 0"
        )

    vectors = tidy(vectors)
    queries = tidy(queries).groupBy("id").agg(F.min("v").alias("v"))
    v_parts = max(1, -(-vectors.count() // VECTORS))
    q_parts = max(1, -(-queries.count() // QUERIES))
    grid = {"v_part": v_parts, "q_part": q_parts}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(grid[own])).cast("int")
        return df.withColumns(
            {
                own: part,
                other: F.explode(F.sequence(F.lit(0), F.lit(grid[other] - 1))),
                "length": F.size("v"),
            }
        )

    keys = ["v_part", "q_part", "length"]
    found = (
        dealt(queries, "q_part", "v_part")
        .groupBy(*keys)
        .cogroup(dealt(vectors, "v_part", "q_part").groupBy(*keys))
        .applyInPandas(_searched(k), "query_id long, id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id), "score")
    )


def _searched(k: int):
    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "id", "score")})
        query, found, score = search_blocks(
            q["id"].to_numpy(), np.stack(q["v"]), v["id"].to_numpy(), np.stack(v["v"]), k
        )
        return pd.DataFrame({"query_id": query, "id": found, "score": score})

    return run
