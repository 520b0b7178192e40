"""Token counts through a cache keyed by digests of normalised content and of the tokenizer's version.

Texts are joined to stored counts by digest; only distinct texts that miss are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.skew import join_to_unique
from gridloom.session import written

#: Characters handed to the tokenizer at once: bounds the ids held in a worker.
SLICE = 1 << 18
STORED = "digest binary, n_tokens long"


def version_digest(model: bytes) -> str:
    """The tokenizer's version: SHA-256 of its model file."""
    return hashlib.sha256(model).hexdigest()


def content(text_col: str) -> Column:
    """Normalised content: null is the empty text. Nothing else is changed, as any other change could change the count."""
    return F.coalesce(F.col(text_col), F.lit(""))


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Counts stored for one tokenizer version, one row for a digest; no rows if there are none yet."""
    path = f"{cache_path}/version={version}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


_MODELS: dict[int, object] = {}


def _processor(model: bytes):
    import sentencepiece

    if hash(model) not in _MODELS:
        _MODELS[hash(model)] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _MODELS[hash(model)]


def encode_misses(misses: DataFrame, model: bytes) -> DataFrame:
    """``digest`` and ``n_tokens`` of ``misses`` (digest, text): whole texts, no begin or end tokens."""
    shared = misses.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _processor(shared.value)
        for batch in batches:
            counts: list[int] = []
            texts: list[str] = []
            for t in batch.column(1):
                texts.append(t.as_py())
                if sum(map(len, texts)) > SLICE or len(texts) > 256:
                    counts += map(len, own.encode(texts, num_threads=1))
                    texts = []
            counts += map(len, own.encode(texts, num_threads=1)) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, STORED)


def fill_cache(docs: DataFrame, model: bytes, cache_path: str, *, text_col: str = "text") -> None:
    """Encode each distinct text of ``docs`` that has no stored count, once, and append its count to the cache.

    Equal texts are merged within each task before the shuffle, so thousands of copies send one row a task. Two runs at
    once may both append a digest; readers take one.
    """
    spark, version = docs.sparkSession, version_digest(model)
    keyed = docs.select(F.unhex(F.sha2(content(text_col), 256)).alias("digest"), content(text_col).alias("text"))
    known = stored_counts(spark, cache_path, version)
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if not known.isEmpty():
        distinct = distinct.join(known.select("digest"), "digest", "left_anti")  # merged texts lie by digest already: only digests move, or few are sent to all
    encode_misses(distinct, model).write.mode("append").parquet(f"{cache_path}/version={version}")


def token_counts(docs: DataFrame, model: bytes, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` for every row, through the cache at ``cache_path``.

    Null text counts as empty: 0 bytes, 0 tokens. A very long text is encoded whole, alone. Null ids and repeated rows stay; an empty table gives no rows. Other
    columns of ``docs`` don't pass, so none can clash. ``cache_path`` must be in a store that all executors share.
    """
    fill_cache(docs, model, cache_path, text_col=text_col)
    counts = stored_counts(docs.sparkSession, cache_path, version_digest(model))
    keyed = docs.select(id_col, F.octet_length(content(text_col)).cast("long").alias("n_bytes"), F.unhex(F.sha2(content(text_col), 256)).alias("digest"))
    return join_to_unique(written(keyed, "text-digests"), counts, "digest").select(id_col, "n_bytes", "n_tokens")
