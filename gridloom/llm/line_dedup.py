"""Lines that repeat across documents, found with a once-seen and a twice-seen Bloom filter.

Pass 1 hashes each document's keys (each key once a document). Each reduce task owns ranges of hashes, their number growing with the
documents, and fills for a range a filter of what was seen once, never kept; what it has seen already is seen twice. Those hashes fill the
twice-seen filter, the only one that goes to the executors: its size follows the number of repeated keys, up to ``MAX_BITS``. Pass 2 sends on
just the keys that the filter suspects, as a 128-bit digest and the document's id; a group-by confirms them exactly and finds the
occurrence that stays. A false alarm of a filter costs a shuffled row, never a wrong result; one past its bound only raises false alarms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.columns import by_place, named_again
from gridloom.operators.skew import join_to_unique
from gridloom.session import written

#: White space stripped from both ends of a line (fixed).
BLANK = b" \t\n\x0b\x0c\r"
#: Parts of the twice-seen filter, probes for a key, bits for a key, and bounds of a filter's bits (128 MB at most).
RANGES, PROBES, BITS_A_KEY, MIN_BITS, MAX_BITS = 64, 2, 16, 1 << 20, 1 << 30
#: Documents for each range of hashes in pass 1, about.
RANGE_DOCS = 1 << 17


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The line's key: stripped and A-Z lower-cased; None if it has too few code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """The different keys of a text."""
    return {k for line in set(text.split(b"\n")) if (k := key_of(line, min_chars)) is not None}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, keys)), dtype=">u8").astype(np.uint64)


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit places inside the range's part of the filter; the range itself is the hash's top 6 bits."""
    per = np.uint64(bits // RANGES - 1)
    return [(hashes >> np.uint64(29 * i)) & per for i in range(PROBES)]


def _seen(filled: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Which keys have all their bits set in a filter of one range, or of all with places moved by range."""
    return np.logical_and.reduce([filled[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 for p in places]).astype(bool)


def _add(filled: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(filled, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def hashed_keys(docs: DataFrame, min_chars: int, range_bits: int, *, text_col: str) -> DataFrame:
    """``hash_range`` (the top ``range_bits`` bits), ``n`` and ``hashes``: hashes of a batch's keys, packed; those in two of its documents stand twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for t in batch.column(0).cast(pa.binary()) if t.is_valid for k in keys_of(t.as_py(), min_chars)]
            if keys:
                h = np.sort(_hashes(keys))
                h = h[np.concatenate([[True, True], h[2:] != h[:-2]])[: len(h)]]  # up to two of each
                which = (h >> np.uint64(64 - range_bits)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(which)) + 1
                parts = np.split(h, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(which[[0, *cuts]]), pa.array([len(p) for p in parts], type=pa.int64()), pa.array([p.astype("<u8").tobytes() for p in parts], type=pa.binary())], names=["hash_range", "n", "hashes"])

    return docs.select(text_col).mapInArrow(run, "hash_range int, n long, hashes binary")


def _bits_for(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_A_KEY * n).bit_length()))


def repeated_hashes(packed: DataFrame, range_bits: int) -> DataFrame:
    """``part``, ``n`` and ``hashes``: hashes that a once-seen filter of their range had when they came, with its false alarms; ``part`` is the top 6 bits."""
    sizes = packed.groupBy("hash_range").agg(F.sum("n").alias("keys"))
    ranged = packed.join(sizes, "hash_range").select("hash_range", "keys", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, bits = None, None, 0
        for batch in batches:
            for r, keys, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != current:
                    current, bits = r, _bits_for(keys * RANGES)
                    once = np.zeros(bits // RANGES // 8, dtype=np.uint8)
                h = np.frombuffer(data, dtype="<u8")
                places = _probes(h, bits)
                again = np.concatenate([[False], h[1:] == h[:-1]]) | _seen(once, places)
                _add(once, [p[~again] for p in places])
                if again.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r >> (range_bits - 6)], type=pa.int32()), pa.array([int(again.sum())], type=pa.int64()), pa.array([h[again].tobytes()], type=pa.binary())], names=["part", "n", "hashes"])

    return ranged.repartition("hash_range").sortWithinPartitions("hash_range").mapInArrow(run, "part int, n long, hashes binary")


def twice_seen(repeated: DataFrame, bits: int) -> bytes:
    """The twice-seen filter over all hashes, ``bits`` long: a bounded result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, twice = None, None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != current:
                    if current is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([current], type=pa.int32()), pa.array([twice.tobytes()], type=pa.binary())], names=["part", "filter"])
                    current, twice = part, np.zeros(bits // RANGES // 8, dtype=np.uint8)
                _add(twice, _probes(np.frombuffer(data, dtype="<u8"), bits))
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], type=pa.int32()), pa.array([twice.tobytes()], type=pa.binary())], names=["part", "filter"])

    parts = repeated.select("part", "hashes").repartition(RANGES, "part").sortWithinPartitions("part").mapInArrow(run, "part int, filter binary")
    out = bytearray(bits // 8)
    for r, part in parts.collect():
        out[r * (bits // RANGES // 8) : (r + 1) * (bits // RANGES // 8)] = part
    return bytes(out)


def suspected(docs: DataFrame, twice: Broadcast, bits: int, min_chars: int, *, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``digest`` of each key that the filter suspects, once a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(twice.value, dtype=np.uint8)
        for batch in batches:
            found = [list(keys_of(t.as_py(), min_chars)) if t.is_valid else [] for t in batch.column(1).cast(pa.binary())]
            keys = [k for ks in found for k in ks]
            if keys:
                h = _hashes(keys)
                offset = (h >> np.uint64(58)) * np.uint64(bits // RANGES)
                hit = np.flatnonzero(_seen(filled, [p + offset for p in _probes(h, bits)]))
                rows = np.repeat(np.arange(len(found)), [len(ks) for ks in found])[hit]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([digest_of(keys[i]) for i in hit], type=pa.binary())], names=[id_col, "digest"])

    schema = T.StructType([docs.schema[id_col], T.StructField("digest", T.BinaryType())])
    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def digest_of(key: bytes) -> bytes:
    """128 bits of BLAKE2b: equal digests are taken for equal keys."""
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` after dropping, and ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents (different ids) lose all their
    lines but those in the largest id that holds them. Null and empty texts are one empty line and become the empty
    text. Rows with a null id are no documents: they don't count and keep their lines. Rows that share an id are one
    document. A very long text is split in the task that holds its row. Columns named ``n_lines`` or ``n_dropped`` are replaced; an empty table gives no rows.
    """
    rows, names = by_place(docs.drop("n_lines", "n_dropped"))
    return named_again(_deduped(rows, min_chars, min_docs, names[id_col], names[text_col]), names, list(names), ["n_lines", "n_dropped"])


def _deduped(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """dedup_lines() of columns named by_place()."""
    named = docs.where(F.col(id_col).isNotNull())
    range_bits = max(6, (docs.count() // RANGE_DOCS).bit_length())
    repeated = written(repeated_hashes(written(hashed_keys(named, min_chars, range_bits, text_col=text_col), "line-hashes"), range_bits), "line-repeats")
    bits = _bits_for(repeated.agg(F.sum("n")).first()[0] or 0)
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(repeated, bits))
    suspects = written(suspected(docs, twice, bits, min_chars, id_col=id_col, text_col=text_col), "line-suspects")
    common = written(suspects.groupBy("digest").agg(F.count_distinct(id_col).alias("n"), F.max(id_col).alias("stays")).where(F.col("n") >= min_docs), "line-common")
    met = join_to_unique(suspects, common.select("digest", "stays"), "digest")
    gone = met.where(F.col(id_col) != F.col("stays")).groupBy(id_col).agg(F.collect_set("digest").alias("__gone"))
    found = named.join(gone, id_col, "left").select(*docs.columns, "__gone")
    joined = found.unionByName(docs.where(F.col(id_col).isNull()).withColumn("__gone", F.lit(None).cast("array<binary>")))
    at, out = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, gone in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                t = t or b""
                n_lines.append(t.count(b"\n") + 1)
                if gone:
                    drop, lines = set(gone), t.split(b"\n")
                    t = b"\n".join(kept := [x for x in lines if (k := key_of(x, min_chars)) is None or digest_of(k) not in drop])
                    n_dropped.append(len(lines) - len(kept))
                else:
                    n_dropped.append(0)
                texts.append(t)
            columns = [*batch.columns[:-1], pa.array(n_lines, type=pa.int64()), pa.array(n_dropped, type=pa.int64())]
            columns[at] = pa.array(texts, type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return joined.mapInArrow(run, out)
