"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates lie in blocks; a block keeps one list per dimension, sorted by that component. A query reads
the lists of its non-zero dimensions from the end where its weight gains most, scores each row when it
is first seen, and stops when the sum of the best products still to come is below its k-th score.
Blocks of the stated queries meet blocks of all rows, so a task holds two bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 1_024
#: Entries read from each list in the first step; each step reads twice as many as the one before.
FIRST_DEPTH = 16
#: Sums of products below these are exact in floats and in longs; beyond, Python integers are used.
FLOAT_EXACT, LONG_EXACT = 1 << 53, 1 << 63


def scaled(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), with x as double, as whole doubles; null if the vector takes no part.

    A double from 2**53 on is whole, so it needs no floor (which would pass through a long).
    """
    whole = lambda x: F.when(F.abs(x) < float(FLOAT_EXACT), F.floor(F.when(F.abs(x) < float(FLOAT_EXACT), x)).cast("double")).otherwise(x)
    usable = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def whole_numbers(rows: np.ndarray) -> np.ndarray:
    """Whole doubles as longs, or as Python integers where one does not fit."""
    return rows.astype(np.int64) if np.abs(rows).max(initial=0) < float(1 << 62) else np.array([[int(x) for x in r] for r in rows], dtype=object)


class SortedLists:
    """The candidates of a block with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0)) if vectors.dtype != object else max(abs(x) for x in vectors.ravel())
        # Only vectors whose sums with one of their own size fit are held as floats.
        self.exact_float = self.most(self.largest) < FLOAT_EXACT
        self.scores_from = self.vectors.astype(np.float64) if self.exact_float else self.vectors
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def most(self, other: int) -> int:
        """No sum of products with a vector of components up to ``other`` is larger than this."""
        return self.largest * other * max(1, self.vectors.shape[1])

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows whose id is not ``own``, ties to the smaller id."""
        n = len(self.ids)
        axes = np.flatnonzero(query)
        most = self.most(max((abs(x) for x in query.tolist()), default=0))
        floats, longs = self.exact_float and most < FLOAT_EXACT, most < LONG_EXACT and object not in (query.dtype, self.vectors.dtype)
        weigh = query.astype(np.float64) if floats else query if longs else query.astype(object)
        weights = query[axes] if longs else weigh[axes]
        falling = weights > 0
        seen = np.zeros(n, dtype=bool)
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64 if longs else object)
        depth, step = 0, FIRST_DEPTH
        while True:
            stop = min(n, depth + step)
            if len(axes):
                entries = np.concatenate([self.lists[axes[falling], n - stop : n - depth].ravel(), self.lists[axes[~falling], depth:stop].ravel()])
                fresh = np.zeros(n, dtype=bool)
                fresh[entries] = True
            else:  # a zero query scores every row alike
                fresh, stop = np.ones(n, dtype=bool), n
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            new = new[self.ids[new] != own]
            if floats:
                found = np.rint(self.scores_from[new] @ weigh).astype(np.int64)
            else:
                found = (self.vectors[new] if longs else self.vectors[new].astype(object)) @ weigh
            best, scores = np.r_[best, new], np.r_[scores, found]
            if len(best) > k:
                kth = np.partition(scores, len(scores) - k)[-k]
                near = scores >= kth
                best, scores = best[near], scores[near]
                pick = np.lexsort((self.ids[best], -scores))[:k]
                best, scores = best[pick], scores[pick]
            depth, step = stop, 2 * step
            if depth >= n or seen.all():
                break
            if len(best) == k:
                at = np.where(falling, self.values[axes, n - 1 - depth], self.values[axes, depth])
                if int((weights * at).sum()) < scores.min():  # an equal bound could still hide a smaller id
                    break
        return self.ids[best], scores


def top_k(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query, ties to the smaller id.

    * Rows with a null id take no part, nor do vectors that are null or have a null or non-finite component.
      Scores are exact whatever their size; one beyond a long is reported (and tied) as the last long. Shorter vectors count as padded with zeros; an empty vector scores 0.
    * Equal rows count once. Rows that share the query's id are its own. Where an id has several vectors,
      a pair of ids has its largest score.
    * Fewer than k other rows give fewer results; an empty table gives none.
    """
    spark = df.sparkSession
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), is_query.alias("asks"), scaled(F.col(vector), scale).alias("v"))
    rows = rows.where(F.col("v").isNotNull()).distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("asks"), F.lit(False)).cast("bigint")).alias("q")).first()
    n_blocks, q_blocks = -(-size["n"] // CANDIDATE_BLOCK) or 1, -(-(size["q"] or 0) // QUERY_BLOCK) or 1
    cut = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "v", cut(n_blocks, 1).alias("c_block"), every(q_blocks).alias("q_block"))
    queries = rows.where("asks").select("id", "v", cut(q_blocks, 2).alias("q_block"), every(n_blocks).alias("c_block"))

    def matrix(vectors: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return whole_numbers(out)

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(c) and len(q):
            width = max(1, max(map(len, c["v"])), max(map(len, q["v"])))
            lists = SortedLists(c["id"].to_numpy(dtype=np.int64), matrix(c["v"], width))
            for own, query in zip(q["id"].to_numpy(dtype=np.int64), matrix(q["v"], width)):
                ids, scores = lists.top(query, own, k)
                fits = scores if scores.dtype == np.int64 else np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], dtype=np.int64)
                parts.append((np.full(len(ids), own), ids, fits))
        names = ("query_id", "vec_id", "score")
        return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i, n in enumerate(names)})

    pairs = candidates.groupBy("q_block", "c_block").cogroup(queries.groupBy("q_block", "c_block")).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
