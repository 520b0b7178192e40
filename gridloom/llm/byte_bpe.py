"""Byte-level BPE encoding and decoding by a sentencepiece model that is written straight from a rank table.

The rank table (token bytes -> rank) becomes a sentencepiece BPE model: every token is a piece whose bytes are
mapped one to one to printable characters, its score is the negative rank, and the normaliser is the identity.
sentencepiece then merges the adjacent pair of highest score, leftmost first, which is the merge of lowest rank.
Texts are cut into pre-tokens by a pattern; each pre-token is encoded by itself. A pre-token that is a token is
taken whole, as the rank tables' own library does. Decoding maps ids back to token bytes.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of texts, or ids, that are held at once, and pre-tokens merged by one call of the model.
SLICE, GROUP = 1 << 22, 1000
#: Stands between pre-tokens in the model's input; no token holds it.
GAP = "\ue000"


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (``base64 rank`` lines), read once on the driver; under 1 MB for a 50k vocabulary."""
    return Path(path).read_bytes()


def parse_ranks(data: bytes) -> list[bytes]:
    """Token bytes by rank. Ranks must run from 0 without gaps, and all 256 single bytes must be tokens."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if sum(len(t) == 1 for t in tokens) != 256:
        raise ValueError("every single byte must be a token")
    return tokens


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: length-delimited bytes, varint, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model: piece i is token i with score -i, then one unknown piece that no text can reach."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    no_ids = b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end and padding ids
    trainer = _field(2, _field(3, 2) + _field(40, len(tokens)) + no_ids)
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normalizer


def stand_ins(pattern: str) -> dict[int, int]:
    """Code points whose class differs between the ``regex`` module and the rank tables' own library.

    The two follow different Unicode versions. Each such code point maps to one that both put into the class that the
    library sees; pre-tokens are cut on the text so translated. Found by asking both about every code point, once on the driver.
    """
    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out: dict[int, int] = {}
    for kind, instead in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", " ")):
        if kind in pattern:
            ours, theirs = regex.compile(kind), tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
            mine, library = set(ours.findall("".join(chars))), set(theirs.decode_bytes(theirs.encode_ordinary("".join(chars))).decode())
            out |= {ord(c): ord(instead) for c in library - mine} | {ord(c): 0xE000 for c in mine - library if ord(c) not in out}
    return out


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most`` in sum; a larger row is a range of its own."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, stop
        at = stop


class Codec:
    """Encoder and decoder of one rank table. It remembers nothing between slices, so its memory follows SLICE alone.

    A slice of texts is first cut at each space that a visible character follows: no pre-token reaches over such a place, so
    the chunks between can be encoded by themselves, each with the space before it, and each different chunk once.
    """

    def __init__(self, data: bytes, pattern: str, differing: dict[int, int] | None = None):
        import regex
        import sentencepiece

        self.tokens = parse_ranks(data)
        self.pieces = pa.array(self.tokens, type=pa.binary())
        chars = byte_characters()
        self.mapped = np.array([*map(ord, chars[:0xFF]), ord(GAP)], dtype="<u2")  # no UTF-8 text holds the byte 0xFF
        self.whole = {"".join(map(chars.__getitem__, t)): i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.pattern, self.differing = regex.compile(pattern), differing or {}
        self.unlike = frozenset(map(chr, self.differing))
        self.place = re.compile(r" (?=\S)")

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or self.unlike.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.differing))]

    def merge(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, side by side, and where each one's begin (and the last ends)."""
        if not pre_tokens:
            return np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        data = np.frombuffer("\udcff".join(pre_tokens).encode(errors="surrogateescape"), dtype=np.uint8)  # that surrogate is the byte 0xFF
        raw = self.mapped[data].tobytes().decode("utf-16-le").split(GAP)
        own = np.array(list(map(self.whole.get, raw, itertools.repeat(-1))), dtype=np.int32)
        other, found = np.flatnonzero(own < 0), []
        for at in range(0, len(other), GROUP):
            found += self.model.encode(GAP.join([raw[i] for i in other[at : at + GROUP].tolist()]), num_threads=1)
            found.append(len(self.tokens))  # what the gap gives: the unknown piece
        merged, sizes = np.array(found, dtype=np.int32), np.ones(len(own), dtype=np.int64)
        ends = np.flatnonzero(merged == len(self.tokens))
        sizes[other] = np.diff(ends, prepend=-1) - 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids, single = np.empty(bounds[-1], dtype=np.int32), np.zeros(bounds[-1], dtype=bool)
        single[bounds[:-1][own >= 0]] = True
        ids[single], ids[~single] = own[own >= 0], np.delete(merged, ends)
        return ids, bounds

    def _chunks(self, chunks: list[str], heads: list[str]) -> pa.ListArray:
        """Ids of chunks, each read with a space before it and cut in one go, and then of the starts of texts."""
        pre_tokens = self.cut(" " + " ".join(chunks)) if chunks else []
        starts = [i for i, p in enumerate(pre_tokens) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        if len(starts) != len(chunks):
            raise ValueError("the pattern has pre-tokens that reach over a space and a visible character")
        for h in heads:
            starts.append(len(pre_tokens))
            pre_tokens += self.cut(h)
        ids, bounds = self.merge(pre_tokens)
        return pa.ListArray.from_arrays(pa.array(bounds[[*starts, len(pre_tokens)]].astype(np.int32)), pa.array(ids))

    def _slice(self, texts: pa.Array) -> pa.ListArray:
        pieces = pc.split_pattern(texts.fill_null(""), " ")
        heads, found = pieces.offsets.to_numpy()[:-1], pieces.flatten().dictionary_encode()
        values, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        blank = np.array([not v or v[0].isspace() for v in values], dtype=bool)
        head = np.zeros(len(at), dtype=bool)
        head[heads] = True
        starts = np.flatnonzero(head | ~blank[at])  # a blank piece belongs to the chunk before it
        sizes = np.diff(np.append(starts, len(at)))
        number = np.cumsum(~blank) - 1
        which, first = number[at[starts]], head[starts]
        chunks = [v for v, b in zip(values, blank.tolist(), strict=True) if not b]

        def joined(rows: np.ndarray) -> list[str]:
            return [" ".join([values[i] for i in at[a : a + n]]) for a, n in zip(starts[rows].tolist(), sizes[rows].tolist(), strict=True)]

        longer = np.flatnonzero((sizes > 1) & ~first)
        which[longer] = len(chunks) + np.arange(len(longer))
        chunks += joined(longer)
        which[first] = len(chunks) + np.arange(len(heads))
        ids = self._chunks(chunks, joined(np.flatnonzero(first))).take(pa.array(which))
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        return pa.ListArray.from_arrays(pa.array(ends[[*np.flatnonzero(first), len(which)]].astype(np.int32)), ids.flatten())

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (m := self.place.search(text, at + SLICE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """Ids of whole texts, slice by slice: none for a null or empty text. A text longer than a slice is encoded in parts and is a slice of its own."""
        sizes = pc.binary_length(texts).fill_null(0).to_numpy()
        for a, b in ranges(sizes, SLICE):
            if sizes[a] > SLICE:
                ids = pa.concat_arrays([self._slice(pa.array([part])).flatten() for part in self._parts(texts[a].as_py())])
                yield pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids)
            else:
                yield self._slice(texts.slice(a, b - a))


def joined_tokens(tokens: pa.BinaryArray, ids: pa.ListArray) -> Iterator[pa.BinaryArray]:
    """The bytes of rows of ids (null: none), slice by slice."""
    sizes = ids.value_lengths().fill_null(0).to_numpy()
    for a, b in ranges(sizes, SLICE):
        ends = np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int32)
        yield pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(ids.slice(a, b - a).flatten())), b"")


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(data: bytes, pattern: str, differing: dict[int, int]) -> Codec:
    """The codec of this Python worker, made once for a rank table and pattern."""
    key = (hash(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern, differing)
    return _CODECS[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), decoded_col: str | None = None) -> DataFrame:
    """``id_col``, the columns ``extra`` and ``ids array<int>`` for every row; one pass without a shuffle. With ``decoded_col`` the ids are also decoded again in that pass, as decode() does.

    Null and empty texts have no ids; a null id, repeated rows and ties keep their rows; an empty table gives none. A very
    long text is encoded in parts that end where no pre-token can, with the ids of the whole. Columns of ``docs`` that aren't named don't pass, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, stand_ins(pattern)))
    docs = docs.select(id_col, *(c for c in extra if c != text_col), text_col)
    passed = len(docs.columns) - (text_col not in extra)
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])]
    schema = T.StructType([*docs.schema.fields[:passed], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, differing = shared.value
        own = codec(data, pattern, differing)
        for batch in batches:
            at = 0
            for ids in own.encode(batch.column(batch.num_columns - 1)):
                for texts in joined_tokens(own.pieces, ids) if decoded_col else [None]:
                    n = len(ids) if texts is None else len(texts)
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns[:passed]), ids.slice(0, n), *([] if texts is None else [texts])], names=schema.names)
                    at, ids = at + n, ids.slice(n)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``out_col`` (binary): the token bytes of each row's ids, joined.

    Null and empty ids give empty bytes; null ids of rows, repeated rows and empty tables pass. A column already named ``out_col`` is replaced.
    """
    encoded = encoded.drop(out_col)
    shared, place = encoded.sparkSession.sparkContext.broadcast(ranks), encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(parse_ranks(shared.value), type=pa.binary())
        for batch in batches:
            at = 0
            for texts in joined_tokens(tokens, batch.column(place)):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, texts], names=[*batch.schema.names, out_col])
                at += len(texts)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())]))
