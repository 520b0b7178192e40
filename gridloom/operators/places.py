"""Places and tags: categories by ordered rules, filters by pattern, dedupe, road classes, name search and parsing."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import in_ring


def tag(name: str) -> Column:
    """A value of the ``tags`` map; null where it is missing."""
    return F.try_element_at("tags", F.lit(name))


def matches(rules: dict[str, tuple[str, ...]]) -> Column:
    """Whether any tag has one of its values."""
    found = [F.coalesce(tag(k).isin(*values), F.lit(False)) for k, values in rules.items()]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def named() -> Column:
    """Whether there is a name."""
    return F.coalesce(F.length(tag("name")) > 0, F.lit(False))


def facility_category() -> Column:
    """The first category whose rule matches (rules for named places pass unnamed ones on); a named town or village is a place before all, and shelters for transport or picnics have none."""
    out = F.when(tag("place").isin(*K.PLACE_TAGS) & named(), "place")
    out = out.when((tag("amenity") == "shelter") & tag("shelter_type").isin(*K.SHELTER_EXCLUDED), F.lit(None).cast("string"))
    for name, named_only, rules in K.FACILITIES:
        out = out.when(matches(rules) & named() if named_only else matches(rules), name)
    return out


def sub_type(category: Column) -> Column:
    """The value that names the kind within a category: the place's own, else the first tag that is there."""
    return F.when(category == "place", tag("place")).otherwise(F.coalesce(*[F.nullif(tag(k), F.lit("")) for k in K.SUB_TYPE_TAGS], F.lit("")))


def dedupe_facilities(rows: DataFrame, order: str) -> DataFrame:
    """The first row by ``order`` for each category, lower-cased name and place to four decimals."""
    w = W.partitionBy("cat", F.lower("name"), F.round("lon", 4), F.round("lat", 4)).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def category_counts(rows: DataFrame, categories: list[str]) -> DataFrame:
    """``category``, ``position`` and ``n`` for each known category, in order; unknown ones are dropped."""
    known = rows.sparkSession.createDataFrame(list(enumerate(categories)), "position long, category string")
    return F.broadcast(known).join(rows.groupBy(F.col("cat").alias("category")).count(), "category", "left").select("category", "position", F.coalesce("count", F.lit(0)).alias("n"))


def drivable() -> Column:
    """Whether a way's tags let cars drive on it."""
    highway = F.coalesce(tag("highway"), F.lit(""))
    closed = (tag("area") == "yes") | (tag("motor_vehicle") == "no") | (tag("motorcar") == "no")
    barred = tag("access").isin("private", "no") & ~F.coalesce(tag("motor_vehicle").isin("yes", "designated"), F.lit(False))
    never = F.coalesce(closed, F.lit(False)) | F.coalesce(barred, F.lit(False)) | F.coalesce(tag("service").isin(*K.NOT_DRIVABLE_SERVICE), F.lit(False))
    return (highway != "") & ~highway.isin(*K.NOT_DRIVABLE) & ~never


def highway_values(value: Column) -> Column:
    """Highway classes of a value that is one class or the text of a list of them; a list that can't be read is one class."""
    items = F.from_json(value, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(value.startswith("["), F.coalesce(items, F.array(value))).otherwise(F.array(value))


def road_rank(value: Column) -> Column:
    """Least rank (most important) among the classes; links count as their road; 4 if unknown."""
    ranks = F.create_map(*[F.lit(x) for kv in K.ROAD_RANK.items() for x in kv])
    found = F.transform(highway_values(value), lambda h: F.coalesce(F.try_element_at(ranks, F.replace(h, F.lit("_link"), F.lit(""))), F.lit(4)))
    return F.coalesce(F.array_min(found), F.lit(4))


def class_code(rank: Column) -> Column:
    """0 major, 1 minor, 2 local."""
    return F.when(rank <= 0, 0).when(rank <= 2, 1).otherwise(2)


def shows(value: Column, classes: tuple[str, ...]) -> Column:
    """Whether any of a road's classes is among those displayed."""
    return F.arrays_overlap(highway_values(value), F.array(*[F.lit(c) for c in classes]))


def hospitals(rows: DataFrame) -> DataFrame:
    """Hospitals (``name``, ``kind``, ``emergency``): excluded names go; major ones stay, or all if fewer than the least number are major; without hospitals, clinics."""
    name = F.coalesce("name", F.lit(""))
    fit = rows.where((F.col("kind") == "hospital") & ~name.rlike(f"(?i){K.HOSPITAL_EXCLUDED}")).withColumn("major", name.rlike(f"(?i){K.HOSPITAL_MAJOR}") | F.coalesce(F.col("emergency"), F.lit(False)))
    counts = fit.agg(F.count_if("major").alias("majors"), F.count("*").alias("fits"))
    both = rows.where("kind = 'clinic'").withColumn("major", F.lit(False)).unionByName(fit).join(F.broadcast(counts), how="cross")
    keep = F.when(F.col("fits") == 0, F.col("kind") == "clinic").otherwise((F.col("kind") == "hospital") & (F.col("major") | (F.col("majors") < K.HOSPITAL_LEAST_MAJOR)))
    return both.where(keep).drop("major", "majors", "fits")


def shelter_fit(shelter_type: Column, amenity: Column, name: Column) -> Column:
    """Whether a place can shelter: none of the excluded types; schools only with a name of the larger kinds."""
    large = F.coalesce(name, F.lit("")).rlike(f"(?i){K.SCHOOL_SHELTER}")
    return ~F.coalesce(shelter_type, F.lit("")).isin(*K.SHELTER_EXCLUDED) & ((F.coalesce(amenity, F.lit("")) != "school") | large)


def poi_frame(rows: DataFrame, ring: Column) -> DataFrame:
    """Rows (``kind``, ``name``, ``lon``, ``lat``, others) inside a ring, one for each kind, name and point: the one of least ``id``."""
    inside = rows.where(in_ring(F.col("lon"), F.col("lat"), ring))
    others = [c for c in rows.columns if c not in ("kind", "name", "lon", "lat")]
    return inside.groupBy("kind", "name", "lon", "lat").agg(F.min_by(F.struct(*others), "id").alias("o")).select("kind", "name", "lon", "lat", "o.*")


def scan_facilities(rows: DataFrame, ring: Column) -> DataFrame:
    """``id``, ``cat``, ``sub``, ``name``, ``lon`` and ``lat`` of tagged points (``id``, ``tags``, ``lon``, ``lat``) that have a category and lie in a ring, without repeats."""
    category = facility_category()
    found = rows.select("id", category.alias("cat"), sub_type(category).alias("sub"), F.coalesce(tag("name"), F.lit("")).alias("name"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))
    return dedupe_facilities(found.where(F.col("cat").isNotNull() & in_ring(F.col("lon"), F.col("lat"), ring)), "id")


@functools.cache
def _bare_letters() -> dict[int, str | None]:
    """Letters to the single letter that their canonical decomposition leaves without its marks, and marks to nothing; by rule, from the Unicode tables."""
    marks = range(0x300, 0x370)
    out: dict[int, str | None] = {}
    for c in range(0xC0, 0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        left = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if ord(x) not in marks)
        if len(left) == 1 and left != chr(c):
            out[c] = left
    return out | dict.fromkeys(marks)


def plain(name: Column) -> Column:
    """Lower case without combining marks (U+0300 to U+036F), also those of composed letters. Letters that decompose into several (Hangul syllables, two-part vowel signs) stay as they are."""
    table = _bare_letters()
    letters = sorted(c for c, to in table.items() if to is not None)
    gone = "".join(chr(c) for c, to in table.items() if to is None)
    return F.translate(F.lower(name), "".join(map(chr, letters)) + gone, "".join(table[c] for c in letters))


def plain_text(text: str) -> str:
    """plain() of a Python string."""
    return text.lower().translate(_bare_letters())


def name_score(name: Column, query: Column, is_place: Column) -> Column:
    """How well a plain name answers a plain query, best first: 0 where it starts with it, 1 where a word does, else 2; places gain 0.6; longer names lose 1/400 a letter."""
    place = F.when(F.startswith(name, query), 0.0).when(F.contains(name, F.concat(F.lit(" "), query)), 1.0).otherwise(2.0)
    return place - F.when(is_place, 0.6).otherwise(0.0) + F.length(name) / 400


def suggestions(names: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """The best names (``id``, ``name``, ``is_place``) that hold every word of a text, both without case and marks: ``rank`` from 1, ``score`` ascending, ties by id."""
    q = plain_text(text).strip()
    rows = names.withColumn("n", plain(F.col("name"))).where("length(n) > 0")
    fits = F.lit(len(q) >= 2)
    for word in q.split():
        fits = fits & F.contains(F.col("n"), F.lit(word))
    found = rows.where(fits).select("id", "name", name_score(F.col("n"), F.lit(q), F.col("is_place")).alias("score")).orderBy("score", "id").limit(limit)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("score", "id")).cast("long"))


def coordinates(text: Column) -> Column:
    """A struct of lat and lon from two numbers in either order that lie in the region; else null."""
    a, b = (F.nullif(F.regexp_extract(text, K.TWO_NUMBERS, i), F.lit("")).try_cast("double") for i in (1, 2))
    lat, lon = (lambda x: x.between(*K.LAT_RANGE)), (lambda x: x.between(*K.LON_RANGE))
    return F.when(lat(a) & lon(b), F.struct(a.alias("lat"), b.alias("lon"))).when(lat(b) & lon(a), F.struct(b.alias("lat"), a.alias("lon")))


def kinds(rules: dict[str, Column]) -> Column:
    """Every kind whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules.items()]))


def escape_html(text: Column) -> Column:
    """Text that is safe inside HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_script(text: Column) -> Column:
    """JSON text that is safe inside a script element: nothing in it can end the element."""
    return F.replace(text, F.lit("</"), F.lit("<\\/"))
