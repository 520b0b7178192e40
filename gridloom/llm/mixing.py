"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is found by bisection:
the one whose weights have a wanted entropy, or the smallest whose weights repeat no source beyond a limit. Each source
gets its weight's part of the token budget: whole passes over its documents, each in an order of its own, and the start of
one more pass. Documents fall into blocks by the part of their source's budget that comes before them, so every block holds the
sources in about their weights; inside a block the order is a permutation.

Prefix sums of a source run over ranges of the permuted order, about as many as a range holds documents, so neither a
source with a third of all rows nor the list of its ranges is one large task. All of it is DataFrame operations on a narrow table
of ids and token counts, which are counted once; one join brings the places to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.columns import by_place, named_again
from gridloom.session import written

#: Sources up to which totals are bisected on the driver; beyond, each step is one aggregation on the executors.
DRIVER_SOURCES = 100_000


def n_tokens(text_col: str) -> Column:
    """Words split at ASCII white space, and one end token, so that no document is free."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def bisect(holds: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The least exponent from low to high for which ``holds``, which stays true once true; high if it never does."""
    if holds(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


class Shares:
    """Statistics of exponentiated token shares, on the driver or by aggregation."""

    def __init__(self, totals: DataFrame, total: int, sources: int):
        self.totals, self.total, self.sources = totals, total, sources
        self.local = np.array([r[0] for r in totals.select("tokens").collect()], dtype=np.float64) / total if sources <= DRIVER_SOURCES else None

    def stats(self, exponent: float) -> tuple[float, float, float]:
        """Sum of powers, entropy of the weights, and the greatest share over weight."""
        if self.local is not None:
            powers = self.local**exponent
            return float(powers.sum()), float(-(powers / powers.sum() * np.log(powers / powers.sum())).sum()), float((self.local / powers * powers.sum()).max())
        p = F.col("tokens") / F.lit(float(self.total))
        powers = F.pow(p, F.lit(exponent))
        z, plogp, most = self.totals.agg(F.sum(powers), F.sum(powers * F.log(powers)), F.max(p / powers)).first()
        return z, math.log(z) - plogp / z, most * z

    def least_ratio(self, exponent: float) -> float:
        """The least share over weight."""
        if self.local is not None:
            powers = self.local**exponent
            return float((self.local / powers * powers.sum()).min())
        p = F.col("tokens") / F.lit(float(self.total))
        low = self.totals.agg(F.min(p / F.pow(p, F.lit(exponent)))).first()[0]
        return low * self.stats(exponent)[0]


def solve(shares: Shares, entropy: float | None, max_passes: float | None, budget: int | None) -> tuple[float, float]:
    """The exponent and the budget in tokens.

    ``entropy`` (a part of the greatest, log of the number of sources) is met by an exponent from 0 to 16; ``max_passes``
    by the least from 0 to 1. Without a ``budget`` it is the least that shows every document at least once.
    """

    def tokens(exponent: float) -> float:
        return float(budget) if budget is not None else shares.total * shares.stats(exponent)[2]

    def passes(exponent: float) -> float:
        return tokens(exponent) / shares.total / shares.least_ratio(exponent)

    if entropy is not None:
        goal = entropy * math.log(max(shares.sources, 1))
        exponent = bisect(lambda a: shares.stats(a)[1] <= goal + 1e-12, 0.0, 16.0)
    elif max_passes is not None:
        exponent = bisect(lambda a: passes(a) <= max_passes + 1e-9, 0.0, 1.0)
    else:
        exponent = 1.0
    return exponent, tokens(exponent)


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float | None = None, max_passes: float | None = 1.5, budget: int | None = None, block_tokens: int = 100_000, seed: int = 5, keep_text: bool = True
) -> DataFrame:
    """All columns of ``docs`` and ``mix_tokens``, ``mix_weight``, ``mix_exponent``, ``mix_pass`` (from 0), ``mix_block`` (from 0) and ``mix_order`` (the permutation in a block: ascending).

    One row for each showing of a document. A source's showings stop with the one that reaches its budget (rounded to
    tokens). Null and empty sources are one source; null and empty texts have the end token only, very long ones count whole. The order is drawn from id,
    source and text; rows that agree in all of them, and rows with a null id, are documents of their own, told apart by the place where
    they were written. Columns named like the new ones are replaced, and without ``keep_text`` the texts are only counted; an empty table gives no rows.
    """
    new = ["mix_tokens", "mix_weight", "mix_exponent", "mix_pass", "mix_block", "mix_order"]
    rows, named = by_place(docs.drop(*new))
    mixed = _mixed(rows, named[id_col], named[source_col], named[text_col], entropy, max_passes, budget, block_tokens, seed, keep_text)
    return named_again(mixed, named, [c for c in named if keep_text or c != text_col], new)


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, entropy: float | None, max_passes: float | None, budget: int | None, block_tokens: int, seed: int, keep_text: bool) -> DataFrame:
    """mix() of columns named by_place()."""
    sized = docs.withColumns({"__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "mix_tokens": n_tokens(text_col), "__row": F.monotonically_increasing_id()})
    drawn = F.when(F.col(id_col).isNull(), F.xxhash64(text_col, "__row")).otherwise(F.xxhash64(id_col, text_col))
    passed = [c for c in docs.columns if keep_text or c != text_col]
    sized = written(sized.withColumn("__drawn", F.xxhash64(F.lit(seed), "__source", drawn)).select(*passed, "__source", "mix_tokens", "__row", "__drawn"), "mix-rows")
    narrow = sized.select("__row", "__drawn", "__source", "mix_tokens")
    totals = written(narrow.groupBy("__source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-totals")
    total, sources, most = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*"), F.coalesce(F.max("docs"), F.lit(0))).first()
    if not total:
        exponent, tokens, z = 1.0, 0.0, 1.0
    else:
        shares = Shares(totals, total, sources)
        exponent, tokens = solve(shares, entropy, max_passes, budget)
        z = shares.stats(exponent)[0]
    bits, blocks = (most.bit_length() + 1) // 2, max(1, math.ceil(tokens / block_tokens))
    weight = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent)) / F.lit(z)
    plan = totals.select("__source", F.col("tokens").alias("__total"), weight.alias("mix_weight"), F.round(weight * tokens).cast("long").alias("__budget"))
    counted = narrow.join(F.broadcast(plan) if sources <= DRIVER_SOURCES else plan, "__source")
    last = F.ceil(F.col("__budget") / F.col("__total")).cast("int") - 1
    shown = counted.where("__budget > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), last)))
    shown = shown.withColumn("__order", F.xxhash64("mix_pass", "__drawn")).withColumn("__part", F.shiftrightunsigned("__order", 64 - bits) if bits else F.lit(0).cast("long"))
    by = ["__source", "mix_pass", "__part"]
    parts = shown.groupBy(*by).agg(F.sum("mix_tokens").alias("__tokens"))
    before = W.partitionBy("__source", "mix_pass").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(*by, F.coalesce(F.sum("__tokens").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*by).orderBy("__order", "__row").rowsBetween(W.unboundedPreceding, -1)
    placed = shown.join(offsets, by).withColumn("__start", F.col("mix_pass") * F.col("__total") + F.col("__offset") + F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0)))
    showings = placed.where("__start < __budget").select(
        "__row", "mix_weight", "mix_pass", F.floor(F.col("__start") / F.col("__budget") * blocks).cast("long").alias("mix_block"), F.xxhash64(F.lit(seed + 1), "__order").alias("mix_order")
    )
    joined = sized.drop("__source", "__drawn").join(showings, "__row")
    return joined.select(*passed, "mix_tokens", "mix_weight", F.lit(exponent).alias("mix_exponent"), "mix_pass", "mix_block", "mix_order")
