"""Inference of one nested schema from JSON texts, with objects of many names folded to maps.

Equal texts of equal places are grouped first; each is parsed once and its path counters are multiplied by how often it occurs. Names are folded level by
level with joins and counts over path counters: a job or two for each level of nesting, whatever the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import written

#: Distinct names that the objects of a path may show before they count as one name.
MOST_NAMES = 12
#: Path counters that a task holds before it hands them on.
HELD = 100_000
#: Tasks that the counters of one path are dealt to while names are folded.
SALTS = 16

_TYPES = {type(None): "null", bool: "boolean", int: "integer", float: "double", str: "string", list: "array", dict: "object"}
_COUNTERS = T.StructType([T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("type", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "min_len", "max_len"))])


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Whole numbers keep their type only, so they may have any number of digits; NaN and infinities aren't JSON.
_DECODER = json.JSONDecoder(parse_int=lambda digits: 0, parse_constant=_no_constant)


def parsed(text: str | None) -> dict | None:
    """The object that a text is as a whole; None for null, other values, and what is no JSON (or nested deeper than the parser follows)."""
    try:
        value = None if text is None else _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


class Counters:
    """Counts by path and type. Paths are numbered by parent and step, so that a value costs one look-up."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.places: dict[tuple[int, str], int] = {}
        self.counts: dict[tuple[int, str], list[int | None]] = {}

    def place(self, parent: int, step: str) -> int:
        """The number of a step below a path."""
        key = (parent, step)
        if (found := self.places.get(key)) is None:
            found = self.places[key] = len(self.steps)
            self.steps.append(key)
        return found

    def note(self, place: int, kind: str, n: int, size: int | None = None) -> None:
        """``n`` values of one type, arrays with their length."""
        own = self.counts.setdefault((place, kind), [0, size, size])
        own[0] += n
        if size is not None:
            own[1], own[2] = min(own[1], size), max(own[2], size)

    def add(self, place: int, value: object, n: int) -> None:
        """``n`` times a value and all that it holds."""
        stack = [(place, value)]
        while stack:
            at, v = stack.pop()
            kind = _TYPES[type(v)]
            self.note(at, kind, n, len(v) if kind == "array" else None)
            if kind == "object":
                stack += [(self.place(at, "." + name), inner) for name, inner in v.items()]
            elif kind == "array":
                inner = self.place(at, "[]")
                stack += [(inner, x) for x in v]

    def batch(self) -> pa.RecordBatch:
        """All counters as rows."""
        rows: list[list[str]] = []
        for place, _ in self.counts:
            steps = []
            while place:
                place, step = self.steps[place]
                steps.append(step.encode("utf-8", "replace").decode())  # an escaped half of a surrogate pair is no character
            rows.append(steps[::-1])
        n, least, most = (pa.array([c[i] for c in self.counts.values()], pa.int64()) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array([k for _, k in self.counts], pa.string()), n, least, most], names=_COUNTERS.names)


def counters(rows: DataFrame, *, text: Column, group: Column, inner: Column, wrap: Column) -> DataFrame:
    """``steps`` (below ``$``: ``.name`` or ``[]``), ``type``, ``n`` and the least and greatest length of arrays, over all ``rows``.

    A text that is one JSON object stands below its ``group`` and ``inner`` names, as the only element of an array where ``wrap``; any other text (null
    too) counts as type ``bad`` with the single step ``!group``. Of repeated names in an object the last counts.
    """
    grouped = rows.groupBy(text.alias("text"), group.cast("string").alias("group"), inner.cast("string").alias("inner"), F.coalesce(wrap, F.lit(False)).alias("wrap")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counters()
        for batch in batches:
            for content, outer, name, wrapped, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = parsed(content)
                if value is None:
                    own.note(own.place(0, "!" + (outer or "")), "bad", n)
                else:
                    own.add(0, {outer or "": {name or "": [value] if wrapped else value}}, n)
                if len(own.counts) >= HELD or len(own.steps) >= HELD:
                    yield own.batch()
                    own = Counters()
        if own.counts:
            yield own.batch()

    return _merged(grouped.mapInArrow(run, _COUNTERS), "steps", "type")


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))


def infer(rows: DataFrame, *, text: Column, group: Column, inner: Column, wrap: Column, most_names: int = MOST_NAMES) -> DataFrame:
    """One row for each path: ``path``, ``types``, ``n_names``, ``is_map``, ``optional``, ``min_len`` and ``max_len``.

    ``$`` is the object of all groups, below it stand ``.name`` and ``[]`` for elements. ``types`` counts values by type, alphabetically
    (``integer:4|null:1``). Objects of one path, ``$`` apart, that show over ``most_names`` distinct names have them all replaced by ``*``; names are
    counted after replacements above. ``n_names``: distinct names before a path's own replacement, 0 without objects; ``is_map``: they were replaced;
    ``optional``: a name, not ``*``, that some parent object lacks or sets to null. Lengths are those of arrays, else null.

    Null, empty and broken texts are ``bad`` values at ``!group``; a null group or inner name counts as empty, a null wrap as false. Repeated rows all
    count. An empty table gives no rows. Other columns are never read, so none can clash. No task, broadcast or driver gets more than the counters of a
    share of all paths: texts are grouped with partial counts, and the counters of one path are dealt to SALTS tasks.
    """
    whole = written(counters(rows, text=text, group=group, inner=inner, wrap=wrap), "schema-counters")
    first, values = F.get("steps", F.lit(0)), ("type", "n", "min_len", "max_len")
    bad, below = F.coalesce(F.startswith(first, F.lit("!")), F.lit(False)), F.lit(None).cast("string")
    at = whole.select(F.when(bad, first).otherwise("$").alias("path"), below.alias("parent"), F.lit(False).alias("named"), F.when(bad, F.slice("steps", 1, 0)).otherwise(F.col("steps")).alias("rest"), *values)
    depth = at.agg(F.max(F.size("rest")).alias("depth")).first()["depth"] or 0
    names = []
    for level in range(depth):
        step = F.get("rest", F.lit(0))
        member = F.startswith(step, F.lit("."))
        here = at.where(F.size("rest") > 0).where(member).groupBy("path").agg(F.count_distinct(step).alias("n_names"))
        here = written(here.withColumn("is_map", (F.col("n_names") > most_names) & (F.col("path") != "$")), "schema-names")
        names.append(here)
        maps = here.where("is_map").select("path", F.lit(True).alias("folds"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = at.withColumn("salt", F.when(F.size("rest") > 0, F.pmod(F.hash("rest", "type"), F.lit(SALTS))))
        both = dealt.join(maps.hint("shuffle_hash"), ["path", "salt"], "left")
        taken = F.when(F.col("folds") & member, F.lit(".*")).otherwise(step)
        more = F.size("rest") > 0
        moved = both.select(
            F.when(more, F.concat("path", taken)).otherwise(F.col("path")).alias("path"), F.when(more, F.col("path")).otherwise(F.col("parent")).alias("parent"),
            F.when(more, member & (taken != ".*")).otherwise(F.col("named")).alias("named"), F.when(more, F.slice("rest", F.lit(2), F.size("rest"))).otherwise(F.col("rest")).alias("rest"), *values,
        )
        at = written(_merged(moved, "path", "parent", "named", "rest", "type"), f"schema-level-{level}")
    typed = _merged(at.drop("rest"), "path", "parent", "named", "type")
    each = typed.groupBy("path").agg(
        F.max("parent").alias("parent"), F.bool_or("named").alias("named"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit(":"), x["n"])), "|").alias("types"),
        F.sum(F.when(F.col("type") != "null", F.col("n")).otherwise(0)).alias("held"), F.sum(F.when(F.col("type") == "object", F.col("n")).otherwise(0)).alias("objects"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"),
    )
    each = written(each, "schema-paths")
    found = each.join(each.select(F.col("path").alias("parent"), F.col("objects").alias("parents")), "parent", "left")
    for here in names[:1]:
        counted = here
    for here in names[1:]:
        counted = counted.unionByName(here)
    if names:
        found = found.join(counted, "path", "left")
    else:
        found = found.withColumns({"n_names": F.lit(0).cast("long"), "is_map": F.lit(False)})
    optional = F.col("named") & (F.col("held") < F.coalesce("parents", F.lit(0)))
    return found.select("path", "types", F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"), F.coalesce("is_map", F.lit(False)).alias("is_map"), F.coalesce(optional, F.lit(False)).alias("optional"), "min_len", "max_len")
