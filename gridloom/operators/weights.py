"""Criterion weights (pairwise comparison, entropy, conflict), the weighted index, breaks and class statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.cells import risk_class
from gridloom.operators.quantiles import quantiles
from gridloom.operators.rasters import bounds, normalise
from gridloom.session import written


def pairwise_weights(matrix: Sequence[Sequence[float]], max_ratio: float = K.MAX_CONSISTENCY_RATIO) -> dict:
    """Weights, principal eigenvalue, consistency index and ratio of a reciprocal judgement matrix; an inconsistent one is refused."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    if a.shape != (n, n):
        raise ValueError("judgements must be a square matrix")
    mirrored = 1 / a.T
    if np.abs(a / mirrored - 1).max() > 1e-6:
        raise ValueError("a judgement must be the reciprocal of its mirror image")
    w = np.full(n, 1 / n)
    for _ in range(10_000):
        last, w = w, a @ w
        w /= w.sum()
        if abs(w - last).max() < 1e-15:
            break
    value = float((a @ w / w).mean())
    index = (value - n) / (n - 1) if n > 1 else 0.0
    ratio = index / K.RANDOM_INDEX[n] if K.RANDOM_INDEX[n] else 0.0
    if ratio >= max_ratio:
        raise ValueError(f"consistency ratio {ratio:.3f} is not below {max_ratio}")
    return {"weights": w.tolist(), "lambda_max": value, "ci": index, "cr": ratio}


def group_matrix(judgements: DataFrame, n: int) -> list[list[float]]:
    """The judgement matrix of a group: the geometric mean of all judges' values (``i`` < ``j`` from 0, ``value`` > 0) for each pair, and its mirror image.

    Judgements are averaged where they lie; n (n - 1) / 2 means reach the driver. Null or non-positive values don't count; a pair that nobody judged is an error.
    """
    means = judgements.where("value > 0").groupBy("i", "j").agg(F.exp(F.avg(F.log("value"))).alias("value")).collect()
    found = {(r["i"], r["j"]): r["value"] for r in means}
    if missing := [(i, j) for i in range(n) for j in range(i + 1, n) if (i, j) not in found]:
        raise ValueError(f"no judgement of {missing}")
    return [[1.0 if i == j else found[i, j] if i < j else 1 / found[j, i] for j in range(n)] for i in range(n)]


def entropy_weights(cells: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """``criterion`` and ``weight`` by diversity of values, from one aggregation; equal weights where there is none."""
    aggs = [F.count("*").alias("n")]
    for c in criteria:
        x = F.greatest(F.col(c), F.lit(0.0)) + K.WEIGHT_FLOOR
        aggs += [F.sum(x).alias(f"{c}_s"), F.sum(x * F.log(x)).alias(f"{c}_l")]
    spread = [1 + F.try_divide(F.col(f"{c}_l") / F.col(f"{c}_s") - F.log(f"{c}_s"), F.log("n")) for c in criteria]
    total = sum(spread[1:], spread[0])
    rows = [F.struct(F.lit(c).alias("criterion"), F.when(total > 0, s / total).otherwise(F.lit(1 / len(criteria))).alias("weight")) for c, s in zip(criteria, spread, strict=True)]
    return cells.select(*criteria).dropna().agg(*aggs).select(F.inline(F.array(*rows)))


def conflict_weights(cells: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """``criterion`` and ``weight`` by deviation times conflict with the other criteria, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(criteria) for b in criteria[i + 1 :]]
    found = cells.select(*criteria).dropna().agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in criteria], *[F.corr(a, b).alias(f"r_{a}_{b}") for a, b in pairs])
    r = {p: F.coalesce(F.nanvl(f"r_{p[0]}_{p[1]}", F.lit(0.0)), F.lit(0.0)) for p in pairs}
    raw = [F.greatest(F.coalesce(f"sd_{c}", F.lit(0.0)) * sum((1 - v for p, v in r.items() if c in p), F.lit(0.0)), F.lit(K.WEIGHT_FLOOR)) for c in criteria]
    total = sum(raw[1:], raw[0])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), (x / total).alias("weight")) for c, x in zip(criteria, raw, strict=True)])))


def weight_table(spark: SparkSession, cells: DataFrame, criteria: Sequence[str], matrix: Sequence[Sequence[float]]) -> DataFrame:
    """``criterion``, ``ahp``, ``entropy``, ``critic`` and ``combined`` (mean of the first two, normalised)."""
    ahp = spark.createDataFrame(list(zip(criteria, pairwise_weights(matrix)["weights"], strict=True)), "criterion string, ahp double")
    found = ahp.join(entropy_weights(cells, criteria).withColumnRenamed("weight", "entropy"), "criterion").join(conflict_weights(cells, criteria).withColumnRenamed("weight", "critic"), "criterion")
    mean = (F.col("ahp") + F.col("entropy")) / 2
    return found.withColumn("combined", mean / F.sum(mean).over(W.partitionBy(F.lit(0))))


def weighted_index(cells: DataFrame, weights: DataFrame, criteria: Sequence[str], out: str = "risk") -> DataFrame:
    """``cells`` with the weighted index rescaled by its own bounds; null where the first criterion is null."""
    one = weights.agg(*[F.max(F.when(F.col("criterion") == c, F.col("combined"))).alias(f"w_{c}") for c in criteria])
    raw = sum((F.coalesce(c, F.lit(0.0)) * F.col(f"w_{c}") for c in criteria), F.lit(0.0))
    scored = written(cells.join(F.broadcast(one), how="cross").withColumn(out, F.when(F.col(criteria[0]).isNotNull(), raw)).drop(*one.columns), "index")
    return normalise(scored, [out], bounds(scored, [out]))


def quantile_breaks(cells: DataFrame, value: str, at: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """One row ``breaks``: exact quantiles. ``cells`` should be a written table."""
    return quantiles(cells, {"breaks": (value, at)})


def natural_breaks(values: np.ndarray, k: int) -> list[float]:
    """The least values of all but the lowest of k classes of least squared deviation (Fisher's exact dynamic programme); a break belongs to the class above it.

    Values that aren't finite don't count; fewer values than classes are an error.
    """
    x = np.sort(values.astype(float)[np.isfinite(values.astype(float))])
    n = len(x)
    if n < k:
        raise ValueError(f"{n} values can't make {k} classes")
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        return s2[j] - s2[i] - (s[j] - s[i]) ** 2 / (j - i)

    best = np.array([np.inf, *[cost(np.array([0]), j)[0] for j in range(1, n + 1)]])
    cuts = []
    for c in range(2, k + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            total = best[i] + cost(i, j)
            cut[j] = i[np.argmin(total)]
            new[j] = total.min()
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        j = cut[j]
        out.append(float(x[j]))
    return out[::-1]


def jenks(cells: DataFrame, value: str, k: int = 5, probes: int = 1500) -> DataFrame:
    """One row ``breaks``: natural breaks of all finite values, or of ``probes`` quantiles at equal steps where there are more; found on an executor."""
    fine = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf")))
    one = fine.agg(F.collect_list(value).alias("x")) if fine.limit(probes + 1).count() <= probes else quantiles(fine, {"x": (value, [i / (probes - 1) for i in range(probes)])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"breaks": [natural_breaks(np.array(x), k) for x in f["x"]]})

    return one.mapInPandas(run, "breaks array<double>")


def classified(cells: DataFrame, value: str, breaks: DataFrame, out: str = "class") -> DataFrame:
    """``cells`` with the class of a value by one row of breaks."""
    return cells.join(F.broadcast(breaks), how="cross").withColumn(out, risk_class(F.col(value), F.col("breaks"))).drop("breaks")


def class_statistics(spark: SparkSession, cells: DataFrame, breaks: DataFrame, names: Sequence[str] = K.CLASS_NAMES) -> DataFrame:
    """Five rows: class, name, index range, area and percent; a class without cells has area 0. ``cells`` has ``class`` and ``area``."""
    all_ = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "class int, class_name string")
    areas = cells.where("class IS NOT NULL").groupBy("class").agg(F.sum("area").alias("area"))
    edges = F.concat(F.array(F.lit(0.0)), F.col("breaks"), F.array(F.lit(1.0)))
    found = F.broadcast(all_).join(areas, "class", "left").withColumn("area", F.coalesce("area", F.lit(0.0))).join(F.broadcast(breaks), how="cross")
    return found.select(
        "class", "class_name", F.element_at(edges, F.col("class")).alias("index_min"), F.element_at(edges, F.col("class") + 1).alias("index_max"),
        F.col("area").alias("area_km2"), F.coalesce(F.try_divide(F.col("area") * 100, F.sum("area").over(W.partitionBy(F.lit(0)))), F.lit(0.0)).alias("percent"),
    )


def hashed_sample(cells: DataFrame, criteria: Sequence[str], n: int, seed: int, least: int = 100) -> DataFrame:
    """The first n complete cells by a hash of place and seed: the same sample in every run. Fewer than ``least`` complete cells are an error."""
    complete = cells.dropna(subset=list(criteria))
    found = complete.limit(least).count()
    if found < least:
        raise ValueError(f"only {found} complete cells: weights need {least}")
    key = F.md5(F.concat_ws(":", F.col("r").cast("string"), F.col("c").cast("string"), F.lit(str(seed))))
    return complete.orderBy(key).limit(n)
