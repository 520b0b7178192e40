"""Vectors shared by the searches: which rows take part, equal vectors merged, and ids of answers ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import join_to_unique
from gridloom.session import written


def usable(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """``id`` and ``vec`` (array of double) of the rows that take part.

    Left out: null ids, null vectors, null or non-finite components, all-zero vectors if ``nonzero``, and vectors
    whose length is not the commonest one (ties: the longer).
    """
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    found = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine)
    if nonzero:
        found = found.where(F.exists(vec_col, lambda x: x != 0))
    found = found.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    lengths = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.where(F.size("vec") == (lengths["n"] if lengths else 0))


def merged(vectors: DataFrame, is_query: Column, least: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Entries (``key``, ``vec``, ``ids``), one for each different vector, and query ids with their entry's key, both written.

    ``ids`` are the ``least`` smallest different ids that hold the vector and ``key`` the smallest. With ties going to smaller ids
    no other id can be among the first ``least`` answers, so no group of equal vectors is ever expanded. The
    smallest ids are found in each task before the shuffle; repeated rows of an id have one rank.
    """
    near = vectors.withColumn("n", F.dense_rank().over(W.partitionBy("vec").orderBy("id"))).where(F.col("n") <= least)
    entries = written(near.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("key"), "vec", "ids"), name)
    asked = written(vectors.where(is_query).distinct(), f"{name}-asked")
    queries = written(join_to_unique(asked, entries.select("vec", "key"), "vec").select("id", "key"), f"{name}-queries")
    return entries, queries


def ranked(best: DataFrame, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` first ids for each query id, its own left out.

    ``best`` has the best entries (``query``: key of the query's entry, ``key``, ``score``), more than enough of them.
    """
    order = [F.desc("score"), F.asc("vec_id")]
    top = best.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("n") <= k + 1).drop("n")
    ids = top.join(entries.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    first = ids.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    answers = queries.select(F.col("id").alias("query_id"), F.col("key").alias("query")).join(first, "query").where(F.col("query_id") != F.col("vec_id"))
    return answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
