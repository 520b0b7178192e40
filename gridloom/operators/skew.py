"""Joins of a table with frequent keys to a table that has a key once, joins that stay off the driver, and positions in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import written

#: Keys that count as frequent: the rows at or over a part of all rows, so this many keys at most.
HOT_KEYS = 2000


def join_to_unique(many: DataFrame, unique: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """Inner join on ``key``, which ``unique`` holds once. ``many`` should be a written table: it is read three times.

    Keys with ``least`` rows or more, and at least 1/HOT_KEYS of all rows, are joined where their rows are, with a broadcast of
    HOT_KEYS rows at most; only the other rows are shuffled, so no task gets all rows of a frequent key.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("__n"))
    hot = counts.where(F.col("__n") >= max(least, -(-many.count() // HOT_KEYS))).select(key)
    frequent = F.broadcast(unique.join(F.broadcast(hot), key, "left_semi"))
    others = many.join(F.broadcast(hot), key, "left_anti").join(unique, key)
    return many.join(frequent, key).unionByName(others)


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: shuffled and merged at any size, as a broadcast would go through the driver, and in rounds of joins many of them add up."""
    return side.hint("merge")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with its position (from 1) in a total order: sorted by ranges, numbered in each, and moved on by the sizes of the ranges before; no task sorts all rows."""
    sorted_rows = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = sorted_rows.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n")).orderBy("__part").collect()  # a row for each partition
    before, rows = 0, []
    for r in sizes:
        rows.append((r["__part"], before))
        before += r["__n"]
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_rows.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__part").withColumn(out, place).select(*df.columns, out)
