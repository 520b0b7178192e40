"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most ``d`` of their eight bytes, so they share
at least ``8 - d`` bytes at the same positions: the guaranteed minimum of matches. A list of one single byte would hold 1/256 of
all rows, so the eight positions are cut into blocks (four of two bytes for two bits): at most ``d`` blocks are spoilt, so such a pair meets in one of the lists keyed by
the bytes of all blocks but ``d``. There the bytes shared by position are tallied for each pair, over all eight
positions; pairs below the minimum go, and those retained are verified bit by bit. The fingerprints of a list of more than LONG are dealt to lists
keyed by all choices of ``8 - d`` positions that its blocks are part of, which hold ``256 ** d`` different ones at most, whatever the data. A list's members leave as a
spanning star for each linked set, not as pairs.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.components import connected_components
from gridloom.operators.skew import join_to_unique
from gridloom.session import written

#: Posting lists up to this length are verified pair by pair, longer ones by probing each permitted change of bits.
PAIRWISE = 256
#: Fingerprints from which a list is dealt to lists of more positions: as many as those can hold for two bits.
LONG = 1 << 16
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def simhash(text: bytes, words: int = 3, seed: int = 42) -> bytes:
    """The 8-byte fingerprint: a bit is 1 if set in over half of the shingles' hashes. No words: zero."""
    w = text.lower().split()  # bytes: lowers A-Z only and splits at [ \t-\r]
    if not w:
        return bytes(8)
    k = min(words, len(w))
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate([[0], ends[:-1]])[: len(w) - k + 1]
    digest, n, ones = xxhash.xxh64_digest, len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        a, b = starts[at : at + SLICE].tolist(), (ends[k - 1 :][at : at + SLICE] - 1).tolist()
        hashes = b"".join([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``extra`` and ``fp`` (bigint: the 64 bits) of every row. Null text counts as empty: fingerprint zero. A very long text is hashed by SLICE shingles."""
    docs = docs.select(id_col, *(c for c in extra if c not in (id_col, text_col)), text_col)
    passed = [c for c in docs.columns if c != text_col or text_col in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            out = b"".join(simhash(t.as_py() or b"", words, seed) for t in texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(passed))), pa.array(np.frombuffer(out, dtype=">i8").astype(np.int64))], names=[*passed, "fp"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in passed), T.StructField("fp", T.LongType())]))


def _settle(step, n: int) -> np.ndarray:
    """Least reachable index of each of n nodes; ``step`` takes labels to the least label of node and neighbours."""
    label = np.arange(n)
    while True:
        new = step(label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that fingerprints (uint64) share by position."""
    differing = a ^ b
    return 8 - sum(((differing >> np.uint64(8 * p)) & np.uint64(0xFF) != 0).astype(np.int8) for p in range(8))


def star(fps: np.ndarray, max_diff: int, counts: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one posting list (different, ascending uint64) and the first of the set each is linked with, without the firsts.

    Candidates are all pairs of a short list, and in a longer one the pairs that a permitted change of bits leads to. ``counts``, if
    given, gets the numbers of candidate, retained and verified pairs.
    """
    n, least = len(fps), 8 - max_diff
    nears: list[tuple[np.ndarray, np.ndarray]] = []
    if n <= PAIRWISE:
        proposals = [np.triu_indices(n, 1)]
    else:
        free = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [np.uint64(1 << b) for b in range(64) if int(free) >> b & 1]
        changes = [np.bitwise_or.reduce(np.array(c, dtype=np.uint64)) for k in range(1, max_diff + 1) for c in itertools.combinations(bits, k)]
        proposals = (_changed(fps, c) for c in changes)
    for i, j in proposals:
        kept = tally(fps[i], fps[j]) >= least
        i, j = i[kept], j[kept]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_diff
        if counts is not None:
            counts.update(candidates=len(kept), retained=len(i), verified=int(near.sum()))
        if near.any():
            nears.append((i[near], j[near]))

    def step(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i, j in nears:
            np.minimum.at(x, i, x[j])
            np.minimum.at(x, j, x[i])
        return x

    label = _settle(step, n)
    tied = np.flatnonzero(label != np.arange(n))
    return fps[tied], fps[label[tied]]


def _changed(fps: np.ndarray, change: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that differ just by ``change``, each once."""
    at = np.minimum(np.searchsorted(fps, fps ^ change), len(fps) - 1)
    hit = np.flatnonzero((fps[at] == fps ^ change) & (at > np.arange(len(fps))))
    return hit, at[hit]


def blocks(max_diff: int) -> list[tuple[int, ...]]:
    """The eight byte positions in blocks: twice as many as bits may differ, eight at most."""
    return [tuple(int(p) for p in b) for b in np.array_split(np.arange(8), min(8, 2 * max_diff))]


def mask(positions: Iterable[int]) -> int:
    """The bits of byte positions."""
    return sum(0xFF << 8 * p for p in positions)


def links(distinct: DataFrame, max_diff: int = 2) -> DataFrame:
    """``src`` and ``dst`` fingerprints whose edges connect just what pairs differing in up to ``max_diff`` bits connect.

    ``distinct`` has one column ``fp`` without repeated values.
    """
    if not 0 < max_diff < 8:
        raise ValueError("max_diff must be 1 to 7")
    bytes_of = lambda masks: F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])
    keys = [sum(c, ()) for c in itertools.combinations(blocks(max_diff), len(blocks(max_diff)) - max_diff)]
    postings = distinct.select("fp", F.posexplode(bytes_of([mask(k) for k in keys])).alias("positions", "bytes"))
    long = written(postings.groupBy("positions", "bytes").count().where(F.col("count") > LONG).select("positions", "bytes", F.lit(True).alias("long")), "simhash-long")
    if n_long := long.count():
        rest = [[mask((*k, *more)) for more in itertools.combinations(set(range(8)) - set(k), 8 - max_diff - len(k))] for k in keys]
        finer = F.when(F.col("long"), F.array(*[bytes_of(r) for r in rest])[F.col("positions")]).otherwise(F.array("bytes"))
        marked = postings.join(F.broadcast(long) if n_long <= 100_000 else long, ["positions", "bytes"], "left")
        each = marked.select("fp", "positions", F.posexplode(finer).alias("choice", "bytes"), "long")
        postings = each.select("fp", F.when(F.col("long"), (F.col("positions") + 1) * 100 + F.col("choice")).otherwise(F.col("positions")).alias("positions"), "bytes")
    lists = postings.repartition("positions", "bytes").sortWithinPartitions("positions", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, dtype=np.int64)] * 3  # the last list, which may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            fp, positions, key = kept if batch is None else (np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True))
            if not len(fp):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (positions[1:] != positions[:-1]) | (key[1:] != key[:-1])]))
            if batch is None:
                ends = np.append(starts[1:], len(fp))
            else:
                kept = [x[starts[-1] :] for x in (fp, positions, key)]
                starts, ends = starts[:-1], starts[1:]
            some = ends - starts > 1
            found = [star(np.sort(fp[a:b].astype(np.uint64)), max_diff) for a, b in zip(starts[some], ends[some], strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["src", "dst"])

    return lists.mapInArrow(run, "src long, dst long")


def components(prints: DataFrame, max_diff: int = 2, *, id_col: str = "doc_id") -> DataFrame:
    """``prints`` (``id_col``, ``fp``, other columns) and ``component_id``, the least non-null id that a row reaches over links, for every row.

    Equal fingerprints are one node, and the rows of a frequent one stay where they are. Rows with a null id link like others but lend no id; a
    set of such rows only has a null component. Repeated rows stay; an empty table gives none. ``prints`` should be a written table: it is read more than once.
    """
    firsts = written(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-fps")
    nodes = connected_components(links(firsts.select("fp"), max_diff)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = firsts.join(nodes, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return join_to_unique(prints, rooted.join(least, "root").select("fp", "component_id"), "fp").select(*(c for c in prints.columns if c not in ("fp", "component_id")), "fp", "component_id")


def near_duplicates(docs: DataFrame, *, max_diff: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints and components of whole texts, one row for each row of ``docs``."""
    return components(written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "simhash"), max_diff, id_col=id_col)
