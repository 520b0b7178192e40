"""Exact quantiles of columns of any size: no task ever holds more than a checked number of values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values up to which one task may merge a column (the built-in percentile keeps a map of all different values), bucket counts that a pass
#: brings to the driver, and values that the last pass brings there.
ONE_TASK, BUCKETS, LAST = 500_000, 65_536, 200_000


def _ranks(n: int, at: Sequence[float]) -> list[tuple[int, int, float]]:
    """For each quantile the ranks (from 0) below and above it and the part of the way between them."""
    places = [(n - 1) * q for q in at]
    return [(math.floor(p), math.ceil(p), p - math.floor(p)) for p in places]


def _of_ranks(values: DataFrame, wanted: set[int], low: float, high: float, n: int) -> dict[int, float]:
    """The values of ranks of the column ``v`` (no nulls), by counting equal buckets and looking again into those that hold a rank.

    A range is (least value, greatest value, ranks before it, rows in it); one whose ends are equal needs no look.
    """
    found: dict[int, float] = {}
    ranges = [(low, high, 0, n)]
    while True:
        todo = []
        for a, b, before, rows in ranges:
            inside = [r for r in wanted if before <= r < before + rows]
            if a == b:
                found.update(dict.fromkeys(inside, a))
            elif inside:
                todo.append((a, b, before, rows))
        if not todo:
            return found
        v = F.col("v")
        which = F.coalesce(*[F.when((v >= a) & (v <= b), i) for i, (a, b, _, _) in enumerate(todo)]) if len(todo) <= 64 else _range_number(values, todo)
        here = values.withColumn("i", which).where("i IS NOT NULL")
        if sum(rows for *_, rows in todo) <= LAST:
            seen: dict[int, list[tuple[float, int]]] = {}
            for r in here.groupBy("i", "v").count().collect():
                seen.setdefault(r["i"], []).append((r["v"], r["count"]))
            for i, (_, _, before, _) in enumerate(todo):
                for x, count in sorted(seen[i]):
                    found.update({r: x for r in wanted if before <= r < before + count})
                    before += count
            return found
        cuts = max(2, BUCKETS // len(todo))
        ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _, _ in todo])
        end = F.get(ends, F.col("i"))
        bucket = F.least(F.floor((v / 2 - end["a"] / 2) / (end["b"] / 2 - end["a"] / 2) * cuts), F.lit(cuts - 1))
        rows = here.groupBy("i", bucket.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i", "k").collect()
        ranges, before = [], {i: start for i, (_, _, start, _) in enumerate(todo)}
        for r in rows:
            ranges.append((r["a"], r["b"], before[r["i"]], r["n"]))
            before[r["i"]] += r["n"]


def _range_number(values: DataFrame, ranges: list[tuple]):
    """Index of the range that holds ``v``, by counting the starts that it has reached."""
    order = sorted(range(len(ranges)), key=lambda i: ranges[i][0])
    starts = F.array(*[F.lit(ranges[i][0]) for i in order])
    at = F.size(F.filter(starts, lambda s: F.col("v") >= s))
    ends, numbers = F.array(*[F.lit(ranges[i][1]) for i in order]), F.array(*[F.lit(i) for i in order])
    return F.when((at > 0) & (F.col("v") <= F.get(ends, at - 1)), F.get(numbers, at - 1))


def quantiles(cells: DataFrame, wanted: Mapping[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """One row: for each name the exact quantiles (an array, interpolated between ranks) of its column; null where a column has no value.

    Nulls don't count. Up to ONE_TASK rows it is one aggregate; beyond, bucket counts narrow each wanted rank down in a few passes, so
    ``cells`` should be a written table. NaN counts as greater than all.
    """
    if cells.count() <= ONE_TASK:
        return cells.agg(*[F.percentile(F.col(c), F.array(*[F.lit(float(q)) for q in at])).alias(name) for name, (c, at) in wanted.items()])
    out = {}
    for name, (column, at) in wanted.items():
        values = cells.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
        low, high, n, nans = values.agg(F.min("v"), F.max(F.when(~F.isnan("v"), F.col("v"))), F.count_if(~F.isnan("v")), F.count_if(F.isnan("v"))).first()
        if n + nans == 0:
            out[name] = None
            continue
        ranks = _ranks(n + nans, at)
        whole = _of_ranks(values.where(~F.isnan("v")), {r for a, b, _ in ranks for r in (a, b) if r < n}, low, high, n) if n else {}
        of = lambda r, whole=whole: whole.get(r, math.nan)
        out[name] = [of(a) if a == b else (1 - t) * of(a) + t * of(b) for a, b, t in ranks]
    return cells.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"`{name}` array<double>" for name in out))
