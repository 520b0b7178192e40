"""Noding of lines: segments that cross, touch or overlap are split where they meet, and what lies twice stays once.

Places are whole numbers of 1 / SCALE degrees, so that orientation is exact and split points of both segments agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import planar_m
from gridloom.session import written

#: Places in a degree: about a centimetre.
SCALE = 10_000_000
#: Segments from which a bucket is cut into FINER x FINER smaller ones.
DENSE, FINER = 2_000, 16


def segments(lines: DataFrame) -> DataFrame:
    """Different segments (``ax``, ``ay``, ``bx``, ``by``: whole places, a before b) of lines (``points``: lon x, lat y); points alone have none."""
    whole = F.transform("points", lambda p: F.struct(F.round(p["x"] * SCALE).cast("long").alias("x"), F.round(p["y"] * SCALE).cast("long").alias("y")))
    cut = lines.select(whole.alias("w")).select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s"))
    return cut.where("s.a <> s.b").select(F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).distinct()


def _touched(rows: DataFrame, cell: Column) -> DataFrame:
    """``rows`` for each bucket (``cx``, ``cy``) of the given side that a segment runs through: column by column, with the heights that it has there."""
    floor = lambda x: F.floor(x / cell).cast("long")
    wide = rows.withColumn("cx", F.explode(F.sequence(floor(F.col("ax")), floor(F.col("bx")))))
    at = lambda x: F.when(F.col("bx") == F.col("ax"), F.col("ay")).otherwise(F.col("ay") + (F.least(F.greatest(x, F.col("ax")), F.col("bx")) - F.col("ax")) * (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    left, right = at(F.col("cx") * cell), F.when(F.col("bx") == F.col("ax"), F.col("by")).otherwise(at((F.col("cx") + 1) * cell))
    return wide.withColumn("cy", F.explode(F.sequence(floor(F.least(left, right) - 1), floor(F.greatest(left, right) + 1))))


def _buckets(rows: DataFrame, cell: int) -> DataFrame:
    """Segments in buckets of ``cell`` places, those of dense buckets in finer ones: ``size``, ``cx`` and ``cy`` name a bucket."""
    coarse = written(_touched(rows, F.lit(cell)), "noding-buckets")
    dense = written(coarse.groupBy("cx", "cy").count().where(F.col("count") > DENSE).select("cx", "cy", F.lit(True).alias("dense")), "noding-dense")
    marked = coarse.join(dense, ["cx", "cy"], "left")
    fine = max(1, cell // FINER)
    inside = _touched(marked.where("dense").withColumnsRenamed({"cx": "ox", "cy": "oy"}), F.lit(fine)).where((F.floor(F.col("cx") * fine / cell) == F.col("ox")) & (F.floor(F.col("cy") * fine / cell) == F.col("oy")))
    return marked.where("dense IS NULL").select(*rows.columns, F.lit(cell).alias("size"), "cx", "cy").unionByName(inside.select(*rows.columns, F.lit(fine).alias("size"), "cx", "cy"))


def _cuts(rows: DataFrame, cell: int) -> DataFrame:
    """``id``, ``x`` and ``y`` of places inside a segment where another one meets it."""
    here = written(_buckets(rows, cell), "noding-here")
    there = here.select("size", "cx", "cy", *[F.col(c).alias(f"o{c}") for c in rows.columns])
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    apart = (F.col("oax") > F.col("bx")) | (F.col("obx") < F.col("ax")) | (F.least("oay", "oby") > F.greatest("ay", "by")) | (F.greatest("oay", "oby") < F.least("ay", "by"))
    met = here.join(there, ["size", "cx", "cy"]).where((F.col("id") < F.col("oid")) & ~apart)
    den, cx, cy = dx * ey - dy * ex, F.col("oax") - F.col("ax"), F.col("oay") - F.col("ay")
    met = met.withColumns({"den": den, "t": cx * ey - cy * ex, "u": cx * dy - cy * dx})
    sign = F.when(F.col("den") < 0, -1).otherwise(1)
    met = met.withColumns({"den": F.col("den") * sign, "t": F.col("t") * sign, "u": F.col("u") * sign})
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c, d = (place(F.col(f"{n}x"), F.col(f"{n}y")) for n in ("a", "b", "oa", "ob"))
    part = F.col("t") / F.col("den")
    inner = place((F.col("ax") + F.floor(part * dx + 0.5)).cast("long"), (F.col("ay") + F.floor(part * dy + 0.5)).cast("long"))
    at = F.when(F.col("t") == 0, a).when(F.col("t") == F.col("den"), b).when(F.col("u") == 0, c).when(F.col("u") == F.col("den"), d).otherwise(inner)
    crosses = (F.col("den") != 0) & F.col("t").between(0, F.col("den")) & F.col("u").between(0, F.col("den"))
    on_one_line = (F.col("den") == 0) & (F.col("u") == 0)
    own = F.when(crosses, F.array(at)).when(on_one_line, F.array(c, d))
    other = F.when(crosses, F.array(at)).when(on_one_line, F.array(a, b))
    found = met.where(crosses | on_one_line).select(F.explode(F.array(F.struct(F.col("id").alias("id"), own.alias("p"), a.alias("a"), b.alias("b")), F.struct(F.col("oid").alias("id"), other.alias("p"), c.alias("a"), d.alias("b")))).alias("m"))
    each = found.select("m.id", F.explode("m.p").alias("p"), "m.a", "m.b")
    return each.where((F.col("p") > F.col("a")) & (F.col("p") < F.col("b"))).select("id", "p.x", "p.y").distinct()


def noded(rows: DataFrame, cell: int | None = None, max_rounds: int = 20) -> DataFrame:
    """Segments (as from segments()) split wherever they meet another one, each once.

    Segments meet in buckets of about their mean length; dense buckets are cut finer. A split place is rounded to whole places, which may move a piece over another
    one: rounds go on until no piece is met inside. Places inside a segment lie between its ends by (x, y).
    """
    now = written(rows.select("ax", "ay", "bx", "by"), "noded")
    if cell is None:
        cell = int(now.agg(F.avg(F.greatest(F.col("bx") - F.col("ax"), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1) + 1
    for _ in range(max_rounds):
        numbered = written(now.withColumn("id", F.xxhash64("ax", "ay", "bx", "by")), "noded-ids")
        cuts = written(_cuts(numbered, cell), "noded-cuts")
        if cuts.isEmpty():
            return now
        inside = cuts.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("cuts"))
        ends = lambda n: F.struct(F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y"))
        along = lambda p: (p["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))
        ordered = F.array_sort(F.transform(F.coalesce("cuts", F.array().cast("array<struct<x: long, y: long>>")), lambda p: F.struct(along(p).alias("d"), p.alias("p"))))
        way = F.concat(F.array(ends("a")), F.transform(ordered, lambda q: q["p"]), F.array(ends("b")))
        split = numbered.join(inside, "id", "left").select(way.alias("w")).select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s"))
        now = written(split.where("s.a <> s.b").select(F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).distinct(), "noded")
    raise RuntimeError("pieces did not settle")


def as_edges(pieces: DataFrame) -> DataFrame:
    """Noded pieces as edges: ``src`` and ``dst`` (places packed to one number), ``points`` in degrees, ``length`` in metres and no risk."""
    node = lambda n: F.shiftleft(F.col(f"{n}x"), 32).bitwiseOR(F.col(f"{n}y").bitwiseAND(F.lit(0xFFFFFFFF)))
    point = lambda n: F.struct((F.col(f"{n}x") / SCALE).alias("x"), (F.col(f"{n}y") / SCALE).alias("y"))
    metres = planar_m(F.col("ax") / SCALE, F.col("ay") / SCALE, F.col("bx") / SCALE, F.col("by") / SCALE)
    return pieces.select(node("a").alias("src"), node("b").alias("dst"), F.array(point("a"), point("b")).alias("points"), metres.alias("length"), F.lit(0.0).alias("risk"))
