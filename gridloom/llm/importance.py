"""Target-distribution importance resampling: hashed n-gram features of a target and of raw texts, weights by their ratio, and a draw without replacement.

DuckDB runs once in each Spark task: SQL unnests words, windows them to n-grams and counts buckets, with CRC-32 as a registered function. The
counts of each text are spilled to Parquet in the shared folder; Spark merges them and scores each text in its own row.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.skew import numbered
from gridloom.session import written

#: Bytes of text that DuckDB gets at a time (one text at least), and the memory it may take before it spills to the task's own folder.
SLICE, MEMORY = 4 << 20, "400MB"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(grams: pa.ChunkedArray) -> pa.Array:
    """Unsigned CRC-32 of UTF-8 bytes, read where Arrow holds them."""
    sums: list[int] = []
    for chunk in grams.cast(pa.large_binary()).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        data = bytes(chunk.buffers()[2] or b"")
        sums += [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.array(sums, pa.int64())


def features_sql(longest: int, buckets: int) -> str:
    """SQL over ``batch`` (``row``, ``text``): ``n_words`` and the sorted ``buckets`` of all runs of 1 to ``longest`` words with their ``counts``."""
    joined = ["word", *(" || ' ' || ".join(["word", *(f"lead(word, {j}) OVER o" for j in range(1, n))]) for n in range(2, longest + 1))]
    return f"""
WITH words AS (
  SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT row, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM batch)
), runs AS (
  SELECT row, unnest([{", ".join(joined)}]) AS gram FROM words WINDOW o AS (PARTITION BY row ORDER BY i)
), counted AS (
  SELECT row, CAST(crc32(gram) % {buckets} AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM runs WHERE gram IS NOT NULL GROUP BY ALL
), listed AS (
  SELECT row, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY row
), sized AS (
  SELECT row, count(*) AS n_words FROM words GROUP BY row
)
SELECT batch.row, coalesce(n_words, 0) AS n_words, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM batch LEFT JOIN listed ON listed.row = batch.row LEFT JOIN sized ON sized.row = batch.row ORDER BY batch.row
"""


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield a, b
        a = b


def features(docs: DataFrame, *, longest: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words`` and the bucket counts (``buckets``, ``counts``: arrays of equal length) of every whole text.

    Null and empty texts have no words; null ids and repeated rows keep their rows; an empty table gives none. Columns that aren't named don't pass,
    so none can clash. A very long text is one slice of its own: DuckDB spills beyond MEMORY.
    """
    rows = docs.select(id_col, F.col(text_col).alias("text" if id_col != "text" else "text_"))
    sql = features_sql(longest, buckets)
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([rows.schema[id_col], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill}) as con:
            con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for a, b in _slices(batch.column(1)):
                    texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
                    con.register("batch", pa.table({"row": pa.array(range(b - a), pa.int32()), "text": texts}))
                    found = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    columns = [found.column(f.name).cast(pa.int64() if f.name == "n_words" else pa.list_(pa.int32())).combine_chunks() for f in kinds]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def totals(found: DataFrame) -> DataFrame:
    """``bucket`` and ``n`` over all rows of features(): partial sums in each task, then at most a row for each bucket and task is shuffled."""
    return found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with the array ``gains``: for each bucket floor(1000 ln(p / q)) of the target against the raw texts, both with one added to each bucket."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    sums = both.agg(F.sum("s").alias("raw"), F.sum("t").alias("target"))
    ratio = (F.col("t") + 1) * (F.col("raw") + buckets) / ((F.col("s") + 1) * (F.col("target") + buckets))
    each = both.join(F.broadcast(sums), how="cross").select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))
    return each.agg(F.sort_array(F.collect_list(F.struct("bucket", "gain")))["gain"].alias("gains"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first eight hex digits of SHA-256 of ``seed:key``; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` for every row of ``docs``.

    ``weight``: the floored mean of the features' gains (none: 0). ``score``: weight plus noise, so that the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Of the N rows with ``least_words`` words, floor(``percent`` N / 100) are drawn: ``rank`` from 1, ties
    to the smaller id; null where not drawn. Nulls, empty and long texts, repeated rows: see features(). An empty target weighs all buckets alike, an
    empty table gives no rows. Ranks are counted by sorted ranges: no task sorts all rows.
    """
    found = written(features(docs, longest=longest, buckets=buckets, id_col=id_col, text_col=text_col), "importance-features")
    wanted = written(features(target.select(F.col(target_col).alias("text"), F.lit(0).alias("id")), longest=longest, buckets=buckets, id_col="id"), "importance-target")
    table = written(gains(totals(found), totals(wanted), buckets), "importance-gains")
    gain = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get("gains", b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    summed = found.withColumn("gains", table.select("gains").scalar()).select(F.col(id_col).alias("key"), "n_words", n.alias("n_features"), gain.alias("gain"))
    floored = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = written(summed.select("key", (F.col("n_words") >= least_words).alias("long_enough"), "n_features", floored.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "importance-scores")
    drawn = scored.where("long_enough").count() * percent // 100
    placed = numbered(scored, [F.desc("long_enough"), F.desc("score"), "key", "n_features", "weight"], "place")
    return placed.select(F.col("key").alias(id_col), "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
