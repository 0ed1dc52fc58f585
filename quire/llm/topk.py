"""Exact top-k search by aggregation of sorted lists without random access.

Every component has a list of the vectors by its value, read from the end that
raises the score.  What is read gives each vector a lower and an upper bound of its
score; reading stops for a query once no vector outside its survivors can qualify,
and the survivors' final scores are resolved.  Vectors and queries meet in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import pick, stored

SCALE = 256
# Shares of each list that are read before the bounds are looked at again.
DEPTHS = (0.5, 0.75)
BLOCK = 4096
QUERY_BLOCK = 1024
# Queries whose bounds are held at a time, and the survivors that end a query's reading.
TOGETHER = 256
FEW = 64


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``vector`` (floor of ``scale`` times each component).

    Rows without an id, and vectors that are null, empty or hold a null or non-finite
    component, take no part.  Rows that share an id are vectors of their own.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        pick(rows, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("vector"),
        )
    )


class SortedLists:
    """A block's vectors as sorted lists, one a component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.x, self.ids = vectors, ids
        n = len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(n)[:, None], axis=0)
        self.lists = np.take_along_axis(vectors, order, axis=0)

    def read(self, depth: int):
        """What the first ``depth`` entries from the top and from the bottom tell."""
        n = len(self.x)
        top, bottom = self.rank >= n - depth, self.rank < depth
        seen = np.hstack([np.where(top, self.x, 0.0), np.where(bottom, self.x, 0.0)])
        unseen = np.hstack([~top, ~bottom]).astype(np.float64)
        return seen, unseen, self.lists[n - depth], self.lists[depth - 1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best vectors of a block, itself left out."""
    peak = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if peak >= 2**53:  # beyond exact doubles: plain integer products
        found = []
        for i, w in zip(query_ids, q):
            rest = ids != i
            scores = x[rest] @ w
            found += [(int(i), int(ids[rest][j]), int(scores[j])) for j in _best(scores, ids[rest], k)]
        return found
    lists = SortedLists(x.astype(np.float64), ids)
    n = len(ids)
    depths = [max(1, math.ceil(n * d)) for d in DEPTHS] if n > FEW else []
    reads = [lists.read(d) for d in depths]
    low_end, high_end = lists.lists[0], lists.lists[-1]
    found = []
    for at in range(0, len(q), TOGETHER):
        weights, names = q[at : at + TOGETHER].astype(np.float64), query_ids[at : at + TOGETHER]
        survivors: list[np.ndarray | None] = [None] * len(weights)
        open_ = np.arange(len(weights))
        for seen, unseen, from_top, from_bottom in reads:
            if not len(open_):
                break
            up, down = np.maximum(weights[open_], 0), np.minimum(weights[open_], 0)
            known = seen @ np.hstack([up, down]).T
            lower = known + unseen @ np.hstack([up * low_end, down * high_end]).T
            upper = known + unseen @ np.hstack([up * from_top, down * from_bottom]).T
            own = ids[:, None] == names[open_][None, :]
            lower[own] = upper[own] = -np.inf
            # A vector that can tie with the k-th may have the smaller id: it stays.
            bound = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
            stay = (upper >= bound) & ~own
            ended = stay.sum(axis=0) <= FEW
            for j in np.flatnonzero(ended):
                survivors[open_[j]] = np.flatnonzero(stay[:, j])
            open_ = open_[~ended]
        for j, name in enumerate(names):
            # Where the bounds never closed, the lists are read to their ends.
            left = survivors[j] if survivors[j] is not None else np.flatnonzero(ids != name)
            scores = lists.x[left] @ weights[j]
            found += [(int(name), int(ids[left[i]]), int(scores[i])) for i in _best(scores, ids[left], k)]
    return found


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's ``k`` highest inner products: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the ids divisible by ``every``; a query's own id is no candidate, and
    vectors of another length are none.  Fewer than ``k`` candidates give fewer rows;
    ties go to the smaller id.  Every row is a candidate, those that share an id too; of
    queries that share one the best of all their rows are told.  An empty table gives no
    rows; other columns are not looked at.
    """
    numbered = integer_vectors(rows, scale).withColumn("row", F.monotonically_increasing_id())
    vectors = stored(numbered, "vectors").withColumn("width", F.size("vector"))
    n = vectors.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n / every / query_block))
    spot = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "row"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = vectors.where(F.col("vec_id") % every == 0)
    # The stated queries against all rows, in blocks: each pair of blocks is one group.
    side = vectors.select("width", "vec_id", "vector", spot(1, blocks).alias("block"), each(query_blocks).alias("query_block"))
    asked = queries.select("width", "vec_id", "vector", spot(2, query_blocks).alias("query_block"), each(blocks).alias("block"))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            found = search_block(
                np.stack(left["vector"].to_numpy()), left["vec_id"].to_numpy(),
                np.stack(right["vector"].to_numpy()), right["vec_id"].to_numpy(), k,
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["width", "query_block", "block"]
    met = side.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
