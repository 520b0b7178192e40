"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; a pair of codes is a cell. A query visits cells by the sum of its two
distances (negative inner products with the halves' centroids), taken from a heap over the two sorted lists, until the visited cells hold a
given share of all entries; visited entries are ranked by exact inner products in double precision. Codebooks, and the
share that reaches ``recall`` on them, are found on a bounded sample; every usable row is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.vectors import merged, ranked, usable
from gridloom.session import written

#: Entries and query entries that meet in one task call at most, about; both are split by hash beyond.
BLOCK, QUERY_BLOCK = 8192, 4096
#: Queries multiplied at once, and queries whose cells one task looks for.
STRIP, VISITS = 256, 128
#: Shares of the entries that are tried for the wanted recall.
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random choice of points; an empty one stays where it was."""
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        label = nearest(points, centroids)
        n = np.bincount(label, minlength=len(centroids))
        sums = np.stack([np.bincount(label, weights=points[:, d], minlength=len(centroids)) for d in range(points.shape[1])], axis=1)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each point."""
    return ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)


@dataclass
class Codebooks:
    """The two halves' centroids."""

    first: np.ndarray
    second: np.ndarray

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of both halves."""
        half = self.first.shape[1]
        return nearest(points[:, :half], self.first), nearest(points[:, half:], self.second)

    def visit(self, query: np.ndarray, sizes: list[list[int]], wanted: float) -> np.ndarray:
        """A boolean matrix of the cells taken, by ascending sum of distances, until they hold ``wanted`` entries; ``sizes`` are the cells' entries."""
        half = self.first.shape[1]
        a, b = -(self.first @ query[:half]), -(self.second @ query[half:])
        at_a, at_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, rows, columns = a[at_a].tolist(), b[at_b].tolist(), at_a.tolist(), at_b.tolist()
        pairs, taken = [], np.zeros((len(a), len(b)), dtype=bool)
        heap, reached = [(a[0] + b[0], 0, 0)], [0] * len(a)  # reached: next column of each row
        while heap and wanted > 0:
            _, i, j = heapq.heappop(heap)
            if size := sizes[rows[i]][columns[j]]:
                pairs.append((i, j))
                wanted -= size
            reached[i] = j + 1
            if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < len(a) and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if pairs:
            i, j = np.array(pairs).T
            taken[at_a[i], at_b[j]] = True
        return taken


def fit(sample: np.ndarray, n: int, recall: float, k: int, seed: int, probes: int = 200) -> tuple[Codebooks, float]:
    """Codebooks, with more codes the more entries there are, and the least share that reaches ``recall`` on the sample.

    Among the sample's entries a query's nearest are farther than among all, so the measured recall errs to the low side.
    """
    rng, half = np.random.default_rng(seed), max(1, sample.shape[1] // 2)
    codes = int(min(1024, max(1, len(sample) // 16), max(4, 2 ** round(math.log2(8 * n**0.25)))))
    books = Codebooks(kmeans(sample[:, :half], codes, rng), kmeans(sample[:, half:], codes, rng))
    i, j = books.cells(sample)
    sizes = np.zeros((codes, len(books.second)), dtype=np.int64)
    np.add.at(sizes, (i, j), 1)
    chosen = rng.permutation(len(sample))[:probes]
    scores = sample[chosen] @ sample.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
    held = sizes.tolist()
    for share in SHARES:
        hits = [books.visit(sample[q], held, share * len(sample))[i[x], j[x]].mean() for q, x in zip(chosen, near, strict=True)]
        if np.mean(hits) >= recall:
            break
    return books, share


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.95, sample_rows: int = 20_000, sample_bytes: int = 64 << 20, seed: int = 11) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (double): the ``k`` nearest found of each query row, itself left out.

    ``is_query`` is a condition on ``id``. See vectors.usable() for rows that take no part. Equal vectors are one entry; repeated
    rows of an id and vector count once. Ties go to the smaller id; with too few candidates all are returned; an empty table gives no rows.
    Codebooks are fitted on ``sample_rows`` entries at most, and fewer of very long vectors: ``sample_bytes`` at most reach the driver.
    """
    spark = vectors.sparkSession
    entries, queries = merged(usable(vectors, id_col, vec_col, nonzero=True), is_query, k + 1, "index-entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(entries.select("vec").first()["vec"])
    drawn = entries.orderBy(F.xxhash64("key"), "key").limit(max(1, min(sample_rows, sample_bytes // (8 * width)))).select("vec").toArrow()
    sample = drawn.column(0).combine_chunks().flatten().to_numpy().reshape(-1, width)
    books, share = fit(sample, n, recall, k, seed)
    shared, codes = spark.sparkContext.broadcast(books), (len(books.first), len(books.second))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            if batch.num_rows:
                i, j = shared.value.cells(points)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([p.tobytes() for p in points], type=pa.binary())], names=["key", "i", "j", "vec"])

    index = written(entries.select("key", "vec").mapInArrow(place, "key long, i int, j int, vec binary"), "index")
    sizes = np.zeros(codes, dtype=np.int64)
    for r in index.groupBy("i", "j").count().collect():  # as many rows as cells
        sizes[r["i"], r["j"]] = r["count"]
    blocks, held = np.maximum(1, -(-sizes.sum(axis=1) // BLOCK)).tolist(), sizes.tolist()
    asked = index.join(queries.select("key").distinct(), "key", "left_semi").select("key", "vec")
    n_asked = queries.select("key").distinct().count()
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    every = F.array(*[F.lit(int(b)) for b in blocks])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                taken = shared.value.visit(np.frombuffer(vec), held, share * n)
                rows = np.flatnonzero(taken.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key)), pa.array(rows.astype(np.int32)), pa.array([vec] * len(rows), type=pa.binary()), pa.array([np.packbits(taken[r]).tobytes() for r in rows], type=pa.binary())], names=["query", "i", "vec", "cells"])

    def salt(column: str, into: Column | int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(into) if isinstance(into, int) else into).cast("int")

    of_cell = F.element_at(every, F.col("i") + 1)
    left = index.withColumn("block", salt("key", of_cell)).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.repartition(max(1, -(-n_asked // VISITS)), "key").mapInArrow(visits, "query long, i int, vec binary, cells binary")
    right = right.withColumn("query_block", salt("query", query_blocks)).withColumn("block", F.explode(F.sequence(F.lit(0), of_cell - 1)))

    def meet(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(there):
            here = here.sort_values("key")
            keys, j = here["key"].to_numpy(), here["j"].to_numpy()
            points = np.frombuffer(b"".join(here["vec"])).reshape(len(here), -1)
            for at in range(0, len(there), STRIP):
                part = there.iloc[at : at + STRIP]
                open_cells = np.unpackbits(np.frombuffer(b"".join(part["cells"]), dtype=np.uint8).reshape(len(part), -1), axis=1).astype(bool)[:, j]
                scores = np.where(open_cells, np.frombuffer(b"".join(part["vec"])).reshape(len(part), -1) @ points.T, -np.inf)
                best = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] if scores.shape[1] > k else np.full(len(part), -np.inf)
                q, v = np.nonzero((scores >= best[:, None]) & (scores > -np.inf))
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[q], "key": keys[v], "score": scores[q, v]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": "int64", "key": "int64", "score": "float64"})

    by = ["i", "block", "query_block"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "query long, key long, score double")
    return ranked(best, entries, queries, k)
