"""Exact top-k search of integer inner products by no-random-access aggregation (Fagin, Lotem and Naor 2003).

For each query the score of a vector is the sum of one contribution for each component. Every block of vectors keeps one sorted list for each
component; a query reads all its lists in order of falling contribution (from the other end where its component is negative),
only forward. A vector's lower bound adds the least value of each list where it was not seen yet, its upper bound the value that the list has come
to. Reading stops when no vector outside a small set can reach the k-th lower bound; final scores are resolved for that set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.vectors import merged, ranked, usable

#: Vectors and query vectors of one block.
BLOCK, QUERY_BLOCK = 16384, 512
#: Part of the lists read before the bounds are first looked at, and the part of what is left that is still left at the next look.
FIRST, STILL = 0.5, 0.65


class Lists:
    """The sorted lists of one block, read from either end."""

    def __init__(self, points: np.ndarray):
        self.points, self.size, self.first = points, len(points), FIRST
        self.most = max(int(points.max(initial=0)), -int(points.min(initial=0)))
        rising = np.argsort(points, axis=0, kind="stable").T.copy()
        self.order, self.values = rising, np.take_along_axis(points.T, rising, axis=1)
        self.typed: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of all vectors that can be among the first ``k`` of this block, ties included, and the entries read.

        Bounds and scores are whole numbers, exact in the type chosen for them: floating where it holds them, else 64-bit integers, else
        Python's own. Bounds are first looked at a little before where the last query's reading stopped.
        """
        greatest = sum(abs(int(x)) for x in query) * self.most
        kind = np.float32 if greatest < 1 << 24 else np.float64 if greatest < 1 << 53 else np.int64 if greatest < 1 << 63 else object
        whole = np.float64 if kind == np.float32 else kind
        if whole not in self.typed:
            self.typed[whole] = self.points.astype(whole), self.values.astype(whole)
        (points, values), query = self.typed[whole], query.astype(whole)
        lists = [(o, v * x) if x <= 0 else (o[::-1], v[::-1] * x) for o, v, x in zip(self.order, values, query, strict=True)]
        least = np.array([v[-1] for _, v in lists], dtype=kind)
        known, unseen, done, depth = np.zeros(self.size, dtype=whole), np.ones((len(query), self.size), dtype=kind), 0, self.first
        while True:
            stop = min(self.size, int(np.ceil(depth * self.size)))
            for row, (o, v) in zip(unseen, lists, strict=True):
                read = o[done:stop]
                known[read] += v[done:stop]
                row[read] = 0
            done = stop
            if done == self.size:
                candidates = np.arange(self.size)
                break
            last = np.array([v[done - 1] for _, v in lists], dtype=kind)
            lower = known + least @ unseen
            candidates = np.flatnonzero(known + last @ unseen >= np.partition(lower, -k)[-k]) if self.size > k else np.arange(self.size)
            if len(candidates) <= 8 * k:
                break
            depth = 1 - (1 - depth) * STILL if self.size * (1 - depth) > 8 else 1.0
        self.first = max(FIRST, 1 - (1 - depth) / STILL * 1.1)
        scores = points[candidates] @ query  # resolves the scores of those left
        if len(candidates) > k:
            kept = scores >= np.partition(scores, -k)[-k]
            candidates, scores = candidates[kept], scores[kept]
        return candidates, scores, done * len(query)


def search(vectors: DataFrame, is_query: Column, *, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (long): the ``k`` best rows of each query row, itself left out.

    Components are ``floor(scale * x)``. ``is_query`` is a condition on ``id``. See vectors.usable() for rows that take no part; zero vectors do.
    Equal vectors are one entry; repeated rows of an id and vector count once. Ties go to the smaller id; with too few candidates all are returned; an empty table gives no
    rows. The stated queries meet all vectors block by block. Scores are exact for all finite components; one that 64 bits can't hold is an error, as ``score`` is a long.
    """
    rows = usable(vectors, id_col, vec_col, nonzero=False)
    rows = rows.select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"))
    entries, queries = merged(rows, is_query, k + 1, "topk-entries")
    n, asked = entries.count(), entries.join(queries.select("key").distinct(), "key", "left_semi").select("key", "vec")
    n_blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))

    def copies(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def salt(count: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")

    left = entries.select("key", "vec", salt(n_blocks).alias("block"), copies(query_blocks).alias("query_block"))
    right = asked.select(F.col("key").alias("query"), F.col("vec").alias("asked"), salt(query_blocks).alias("query_block"), copies(n_blocks).alias("block"))

    def meet(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(there):
            keys, lists = here["key"].to_numpy(), Lists(np.stack(here["vec"].to_numpy()))
            for key, vec in zip(there["query"], there["asked"], strict=True):
                at, scores, _ = lists.top(np.asarray(vec), k + 1)
                out.append(pd.DataFrame({"query": key, "key": keys[at], "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "score": []}).astype("int64")

    by = ["block", "query_block"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "query long, key long, score long")
    return ranked(best, entries, queries, k)
