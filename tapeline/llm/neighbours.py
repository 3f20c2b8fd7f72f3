"""Approximate nearest neighbours by collision counting over single projections.

Vectors are dealt into blocks. In a block every vector is projected on `projections` random lines, and each
line keeps its projections as a sorted array. A query's window on a line is centred on the query's own
projection, and virtual rehashing widens all windows together, round by round, from a small radius. A vector
collides on a line if it lies in the window; vectors that collide on at least `threshold` lines are verified
by their exact distance. A query stops when its windows are `reach` times as wide (to either side) as its
distance to the last of its nearest found: a vector that near collides on a line with the probability that
a normal deviate is within `reach`, so missing the threshold is very unlikely. If the windows hold the whole
block, the search of it is exact.

Queries meet all blocks: their copies are laid out beside each block in groups of bounded size, and only the
best of each block leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS, THRESHOLD, REACH, GROWTH = 48, 32, 1.4, 1.25


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector) of rows with a vector that is neither null, empty, zero nor holds null or non-finite parts."""
    x = F.col(vector).cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("bigint").alias("key"), x.alias("vector"))


def _distance(columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, added up in the order of the components; a vector is a
    column."""
    total = np.zeros(columns.shape[1])
    for column, x in zip(columns, query):
        d = column - x
        d *= d
        total += d
    return np.sqrt(total)


class Block:
    """Sorted projections of the vectors of one block."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, seed: int = 7) -> None:
        self.keys, self.columns = keys, np.ascontiguousarray(vectors.T)
        self.lines = np.random.default_rng(seed).standard_normal((PROJECTIONS, vectors.shape[1]))
        shadow = vectors @ self.lines.T
        self.order = np.argsort(shadow, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(shadow.T, self.order, 1)

    def _places(self, at: np.ndarray, side: str = "left") -> np.ndarray:
        return np.array([np.searchsorted(line, x, side) for line, x in zip(self.sorted, at)])

    def search(self, key: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        n, own = len(self.keys), self.lines @ query
        spread = self.sorted[:, -1] - self.sorted[:, 0]
        half, seen = max(float(np.median(spread)) / 16, 1e-12), np.zeros(n, bool)
        seen[self.keys == key] = True                      # a query is no candidate of its own
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        count, low, high = np.zeros(n, np.int16), self._places(own), self._places(own)
        while True:
            # windows only widen: the vectors between the old and the new ends are counted
            new_low, new_high = self._places(own - half), self._places(own + half, "right")
            for line in range(PROJECTIONS):
                order = self.order[line]
                count[order[new_low[line]:low[line]]] += 1
                count[order[high[line]:new_high[line]]] += 1
            low, high = new_low, new_high
            whole = low.max() == 0 and high.min() == n
            new = np.flatnonzero((count >= THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                found_at, found = np.r_[found_at, new], np.r_[found, _distance(self.columns[:, new], query)]
            if whole or seen.all() or len(found) >= k and half >= REACH * np.partition(found, k - 1)[k - 1]:
                best = np.lexsort((self.keys[found_at], found))[:k]
                return [(float(found[i]), int(self.keys[found_at[i]])) for i in best]
            half *= GROWTH


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, batch: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, ties to the smaller vec_id.
    Both inputs are (key, vector) as `usable` gives them; vectors of different lengths never meet; repeated
    rows of an id are one vector. No queries or no other vectors: no rows."""
    vectors, queries = vectors.dropDuplicates(["key"]), queries.dropDuplicates(["key"])
    n, q = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-q // batch))
    laid = vectors.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
                          F.size("vector").alias("dim"), "key", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
                           F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"), F.size("vector").alias("dim"), "key", "vector")

    def meet(cell: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            index = Block(left["key"].to_numpy(), np.array(left["vector"].tolist(), float))
            for key, query in zip(right["key"], right["vector"]):
                out += [(key, other, score) for score, other in index.search(key, np.array(query, float), k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = laid.groupBy("block", "group", "dim").cogroup(asked.groupBy("block", "group", "dim")).applyInPandas(
        meet, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
