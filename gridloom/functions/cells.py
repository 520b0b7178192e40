"""Per-cell expressions: clamping, rescaling, ratings, classes, masks, quantised bytes and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    """x held between two bounds; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def rescale(x: Column, low: Column, high: Column) -> Column:
    """x from [low, high] to [0, 1], clamped; 0 where the bounds are equal."""
    return F.when(x.isNotNull(), F.when(high == low, F.lit(0.0)).otherwise(clamp(F.try_divide(x - low, high - low))))


def steps_reached(x: Column, edges: Column | Sequence[float]) -> Column:
    """How many edges x has reached; an edge counts as reached by its own value."""
    edges = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: x >= e)))


def rating(x: Column, edges: Sequence[float], ratings: Sequence[float]) -> Column:
    """Piecewise constant rating, lower edges inclusive; one more rating than edges."""
    if len(ratings) != len(edges) + 1:
        raise ValueError("ratings must be one more than edges")
    return F.element_at(F.array(*[F.lit(float(r)) for r in ratings]), steps_reached(x, edges) + 1)


def risk_class(x: Column, breaks: Column | Sequence[float]) -> Column:
    """Class from 1 up by breaks; null outside the area."""
    return steps_reached(x, breaks) + 1


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def quantise(x: Column) -> Column:
    """A byte 0 to 254 for [0, 1], 255 for null."""
    return F.when(x.isNull(), F.lit(255)).otherwise(F.bround(clamp(x) * 254).cast("int"))


def dequantise(byte: Column) -> Column:
    """The inverse of quantise(), up to its rounding."""
    return F.when(byte != 255, byte / 254.0)


def _along(x: Column, stops: Sequence[tuple[int, int, int]]) -> list[Column]:
    """Red, green and blue, not rounded, at [0, 1] along equally spaced stops."""
    place = clamp(x) * (len(stops) - 1)
    at = F.least(F.floor(place).cast("int"), F.lit(len(stops) - 2))
    of = [F.array(*[F.lit(float(s[i])) for s in stops]) for i in range(3)]
    return [F.get(a, at) + (F.get(a, at + 1) - F.get(a, at)) * (place - at) for a in of]


def ramp(x: Column, stops: Sequence[tuple[int, int, int]]) -> Column:
    """Colour at [0, 1] along equally spaced stops, as a struct of red, green and blue, rounded half to even; null where x is null."""
    return F.when(x.isNotNull(), F.struct(*[F.bround(p).cast("int").alias(n) for p, n in zip(_along(x, stops), ("red", "green", "blue"), strict=True)]))


def pixel(x: Column, stops: Sequence[tuple[int, int, int]], solid: float | None = None) -> Column:
    """A raster's pixel along equally spaced stops: a struct of red, green, blue and alpha, cut to whole numbers. Low values stay see-through unless ``solid``; null is transparent and has the first colour."""
    value = F.coalesce(clamp(x), F.lit(0.0))
    alpha = F.when(x.isNull(), 0.0).otherwise(F.lit(float(solid)) if solid is not None else value * 0.70 + 0.30)
    parts = [*_along(value, stops), alpha * 255]
    return F.struct(*[F.floor(p).cast("int").alias(n) for p, n in zip(parts, ("red", "green", "blue", "alpha"), strict=True)])


def hex_colour(rgb: Column) -> Column:
    """``#rrggbb`` of a struct of red, green and blue."""
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(rgb[n]), 2, "0")) for n in ("red", "green", "blue")])
