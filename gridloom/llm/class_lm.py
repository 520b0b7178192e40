"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions, smoothed log scores.

``P(text) = prod P(class_i | class_{i-1}) * P(word_i | class_i)`` over the words of a text and one end token; a text
starts after an end token. Classes: the end; ``classes`` classes that hold every word seen twice or more; and one for
words seen once, which also holds all unseen words as one type. The ``exchange_words`` most frequent words move between
the classes by exchange; then each other recurring word goes to the class that raises the bigram likelihood most, by
its counts of neighbouring classes, gathered over all training tokens and merged by ranges of words on the executors, and
moves on in the same way in distributed sweeps of exchange. Every training token counts in all of this, whatever its class.

* Transitions: ``(n(a, b) + prior * P(b)) / (n(a) + prior)`` with ``P(b)`` smoothed by add-one over classes in use. A word seen
  once stands once for itself and once for unseen words (Good-Turing), in the rare class's column and row.
* Emissions: ``n(w) / n(class)``; in the rare class the unseen type takes the part of words seen once.

Words are keyed by 64-bit hashes. Counts and classes of all words are one distributed table, the lexicon. Its most frequent
``hot_limit`` words at most go to the executors (20 bytes each, 20 MB), so no frequent word is ever shuffled for a text; all others are
joined by key, with their classes. Only class-level and bounded word-level statistics reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import written

#: The end token; no word holds a line break.
END = b"\n"
#: Bytes of text whose words are held at once, by batch.
SLICE = 1 << 21
#: Numbers of a unit: the end, then exchange words, then octaves of counts, then rare and unseen words. Units are only for the exchange.
OCTAVES = 64
#: Training tokens of one range of words whose neighbour counts are merged at once, and merged counts weighed at once.
RANGE_TOKENS, WEIGHED = 1_000_000, 1 << 15


def _keys(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">i8").astype(np.int64)


END_KEY = int(_keys([END])[0])


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word keys of texts (null: empty), each text closed by the end token, and tokens per text; by slices of texts."""
    words: list[bytes] = []
    lengths: list[int] = []
    size = 0
    for t in texts.cast(pa.binary()):
        text = t.as_py() or b""
        own = text.lower().split()  # bytes: lowers A-Z only and splits at [ \t-\r]
        own.append(END)
        words += own
        lengths.append(len(own))
        size += len(text)
        if size > SLICE:
            yield _keys(words), np.array(lengths)
            words, lengths, size = [], [], 0
    if lengths:
        yield _keys(words), np.array(lengths)


def held_out(id_col: str, modulus: int = 7, remainder: int = 2) -> Column:
    """Whether a row is held out: CRC-32 of the id as text (null: empty) by ``modulus``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def word_counts(train: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``key`` and ``n`` of every training token: summed in each task by slices, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, _ in tokens(batch.column(0)):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return train.select(text_col).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Hot:
    """The frequent words: sorted keys, counts and units; and totals over all training tokens."""

    keys: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    exchange: int
    n_tokens: int
    n_types: int
    n_once: int

    @property
    def rare(self) -> int:
        """The unit of rare and unseen words."""
        return 1 + self.exchange + OCTAVES

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys among the frequent words, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def units_of(self, keys: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place and unit of each key; ``at``: the places, if known."""
        at = self.find(keys) if at is None else at
        unit = np.where(at >= 0, self.units[at] if len(self.units) else 0, self.rare)
        return at, np.where(keys == END_KEY, 0, unit)


def hot_words(counts: DataFrame, limit: int, exchange: int) -> Hot:
    """The most frequent words seen twice or more, ``limit`` at most; whole eighths of octaves of counts are taken."""
    step = F.when(F.col("n") < 16, F.col("n")).otherwise(F.floor(8 * F.log2(F.col("n").cast("double"))).cast("long"))
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).orderBy(F.desc("least")).collect()
    least, room = None, limit
    for row in steps:
        room -= row["words"]
        if room < 0 or row["least"] < 2:
            break
        least = row["least"]
    found = counts.where(F.col("n") >= least).toArrow() if least else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    keys, n = (found.column(c).to_numpy() for c in ("key", "n"))
    order = np.lexsort((keys, -n))
    order = order[keys[order] != END_KEY]
    units = np.empty(len(keys), dtype=np.int32)
    units[keys == END_KEY] = 0
    units[order[:exchange]] = 1 + np.arange(len(order[:exchange]))
    units[order[exchange:]] = 1 + exchange + np.log2(n[order[exchange:]]).astype(np.int32)
    by_key = np.argsort(keys)
    return Hot(keys[by_key], n[by_key], units[by_key], exchange, sum(r["tokens"] for r in steps), sum(r["words"] for r in steps), sum(r["words"] for r in steps if r["least"] == 1))


def _read_from(train: DataFrame, text_col: str | None) -> DataFrame:
    """What a reader of tokens needs: the texts, or the codes where ``text_col`` is None."""
    return train.select("codes", "others") if text_col is None else train.select(text_col)


def _placed(batch: pa.RecordBatch, hot: Hot, coded: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place among the frequent words and key of each token of a batch of texts or codes, in pieces of whole texts."""
    if coded:
        yield from _coded_tokens(batch, hot)
    else:
        for keys, _ in tokens(batch.column(0)):
            yield hot.find(keys), keys


def unit_pairs(train: DataFrame, hot: Hot, *, text_col: str | None = "text") -> np.ndarray:
    """Counts of neighbouring units over all training tokens, a square matrix of bounded size. ``text_col``: None for rows of codes()."""
    shared, size, coded = train.sparkSession.sparkContext.broadcast(hot), hot.rare + 1, text_col is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for at, keys in _placed(batch, shared.value, coded):
                _, unit = shared.value.units_of(keys, at)
                total += np.bincount(np.concatenate([[0], unit[:-1]]) * size + unit, minlength=size * size)
        rows = total.reshape(size, size)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[u].astype("<i8").tobytes() for u in some], type=pa.binary())], names=["unit", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[u] = total.get(u, 0) + np.frombuffer(row, dtype="<i8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([r.tobytes() for r in total.values()], type=pa.binary())], names=["unit", "counts"])

    out, schema = np.zeros((size, size), dtype=np.int64), "unit int, counts binary"
    for u, row in _read_from(train, text_col).mapInArrow(run, schema).repartition("unit").mapInArrow(add, schema).collect():
        out[u] = np.frombuffer(row, dtype="<i8")
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(pairs: np.ndarray, exchange: int, classes: int, sweeps: int = 10) -> np.ndarray:
    """The class of each unit. Each sweep moves every exchange word to the class that raises the bigram likelihood most.

    The end keeps class 0 and units after the exchange words keep classes of their own, from ``classes + 1`` on.
    """
    units = len(pairs)
    label = np.concatenate([[0], 1 + np.arange(exchange) % classes, classes + 1 + np.arange(units - 1 - exchange)])
    size = label[-1] + 1
    member = np.zeros((units, size))
    member[np.arange(units), label] = 1
    table = member.T @ pairs @ member
    to_class, from_class, own = pairs @ member, pairs.T @ member, np.diag(pairs)
    outs, ins = table.sum(axis=1), table.sum(axis=0)
    choice = slice(1, classes + 1)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, 1 + exchange):
            if not pairs[w].any() and not pairs[:, w].any():
                continue
            was, r, q, s = label[w], to_class[w].copy(), from_class[w].copy(), own[w]
            r[was] -= s  # neighbours other than the word itself
            q[was] -= s
            n_out, n_in = r.sum() + s, q.sum() + s
            table[was] -= r
            table[:, was] -= q
            table[was, was] -= s
            outs[was] -= n_out
            ins[was] -= n_in
            gain = (_xlogx(table[choice] + r) - _xlogx(table[choice])).sum(axis=1) + (_xlogx(table[:, choice].T + q) - _xlogx(table[:, choice].T)).sum(axis=1)
            at = np.arange(1, classes + 1)
            d = table[at, at]
            gain += _xlogx(d + r[at] + q[at] + s) - _xlogx(d + r[at]) - _xlogx(d + q[at]) + _xlogx(d)
            gain -= _xlogx(outs[choice] + n_out) - _xlogx(outs[choice]) + _xlogx(ins[choice] + n_in) - _xlogx(ins[choice])
            now = int(np.argmax(gain)) + 1
            if gain[now - 1] <= gain[was - 1] + 1e-9:
                now = was
            table[now] += r
            table[:, now] += q
            table[now, now] += s
            outs[now] += n_out
            ins[now] += n_in
            if now != was:
                moved += 1
                label[w] = now
                to_class[:, was] -= pairs[:, w]
                to_class[:, now] += pairs[:, w]
                from_class[:, was] -= pairs[w]
                from_class[:, now] += pairs[w]
        if not moved:
            break
    return label


def neighbour_counts(train: DataFrame, hot: Hot, label: np.ndarray, fixed: np.ndarray, *, text_col: str | None = "text") -> DataFrame:
    """``bucket`` and packed ``key``, ``code``, ``n`` of every word that is not among the ``fixed`` keys (sorted) nor the end: how often it has a neighbour of a class.

    ``code`` is the class of the next token, or the number of classes and the class of the token before; the last code counts the word after itself. Summed in each task by slices.
    """
    shared, n_classes = train.sparkSession.sparkContext.broadcast((hot, label, fixed)), int(label[-1]) + 1
    buckets, codes, coded = max(16, hot.n_tokens // RANGE_TOKENS), 2 * n_classes + 1, text_col is None

    def packed(keys: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        klass, fixed = shared.value[1][unit], shared.value[2]
        mine = keys != END_KEY
        if len(fixed):
            mine &= fixed[np.minimum(np.searchsorted(fixed, keys), len(fixed) - 1)] != keys
        after, before = np.append(klass[1:], 0), np.concatenate([[0], klass[:-1]])
        again = np.append(keys[1:] == keys[:-1], False) & mine
        words, at = np.unique(keys[mine], return_inverse=True)
        at *= codes
        pair, n = np.unique(np.concatenate([at + after[mine], at + n_classes + before[mine], at[again[mine]] + codes - 1]), return_counts=True)
        found = words[pair // codes]
        bucket = (found.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = [[], [], [], []]
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            part = order[a:b]
            rows[0].append(int(bucket[order[a]]))
            rows[1].append(found[part].tobytes())
            rows[2].append((pair[part] % codes).astype(_code_type(n_classes)).tobytes())
            rows[3].append(n[part].astype(np.int32).tobytes())
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "key", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for at, keys in _placed(batch, shared.value[0], coded):
                held.append((keys, shared.value[0].units_of(keys, at)[1]))
                size += len(keys)
                if size > 1 << 20:  # a slice ends with an end token, so slices follow on
                    yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return _read_from(train, text_col).mapInArrow(run, "bucket long, key binary, code binary, n binary")


def _code_type(n_classes: int) -> type:
    return np.uint8 if n_classes < 127 else np.int32


def gains(table: np.ndarray, classes: int, now: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of len(now) words the likelihood that it adds to each class from 1 to ``classes``, taken out of its class ``now`` first while all others stay.

    ``table`` counts neighbouring classes with all words in their classes. Entries (``word``, ``code``, ``n``) are those of neighbour_counts(), sorted by word.
    """
    size, words = len(table), len(now)
    own = slice(1, classes + 1)
    alone = np.zeros(words)  # after itself
    repeat = code == 2 * size
    alone[word[repeat]] = n[repeat]
    word, code, n = word[~repeat], code[~repeat], n[~repeat].astype(float)
    ahead, klass = code < size, code % size
    n -= np.where(klass == now[word], alone[word], 0)
    beside = np.zeros((2, words, size))
    beside[(~ahead).astype(int), word, klass] = n
    r, q = beside
    base = np.where(ahead[:, None], table[own][:, klass].T, table[klass][:, own])
    at_home = klass == now[word]
    base[at_home] -= beside[ahead[at_home].astype(int), word[at_home]][:, own]  # what the other side of the word leaves there
    inside = (now[word] >= 1) & (now[word] <= classes)
    e = np.flatnonzero(inside)
    base[e, now[word[e]] - 1] -= n[e] + np.where(at_home[e], alone[word[e]], 0)
    starts = np.searchsorted(word, np.arange(words))
    terms = _xlogx(base + n[:, None]) - _xlogx(base)
    sums = np.concatenate([np.zeros((1, classes)), np.cumsum(terms, axis=0)])
    gain = sums[np.append(starts[1:], len(word))] - sums[starts]
    home = np.zeros((words, size))
    home[np.arange(words), now] = 1
    home = home[:, own]
    rk, qk, s = r[:, own], q[:, own], alone[:, None]
    d = np.diag(table)[own] - home * (rk + qk + s)
    gain += _xlogx(d + rk + qk + s) - _xlogx(d + rk) - _xlogx(d + qk) + _xlogx(d)
    for total, times in ((table.sum(axis=1)[own], r.sum(axis=1)[:, None] + s), (table.sum(axis=0)[own], q.sum(axis=1)[:, None] + s)):
        rest = total - home * times
        gain -= _xlogx(rest + times) - _xlogx(rest)
    return gain


def best_classes(neighbours: DataFrame, table: np.ndarray, classes: int, hot: Hot, label: np.ndarray) -> DataFrame:
    """``key`` and ``klass`` (1 to ``classes``) of every word of neighbour_counts() seen twice or more: the class that raises the likelihood most, by gains(); the one it has stays unless another is better."""
    double, size, code_type = table.astype(float), len(table), _code_type(len(table))
    shared = neighbours.sparkSession.sparkContext.broadcast((hot, label))

    def run(group: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(x, dtype=t) for x in group.column(c).to_pylist()]) for c, t in (("key", np.int64), ("code", code_type), ("n", np.int32))]
        order = np.lexsort((parts[1], parts[0]))
        key, code, n = (x[order] for x in parts)
        first = np.flatnonzero((np.diff(key, prepend=key[0]) != 0) | (np.diff(code.astype(np.int64), prepend=-1) != 0))
        key, code, n = key[first], code[first].astype(np.int64), np.add.reduceat(n.astype(np.int64), first)
        starts = np.flatnonzero(np.append(True, np.diff(key) != 0))
        times = np.add.reduceat(np.where(code < size, n, 0), starts)
        now = shared.value[1][shared.value[0].units_of(key[starts])[1]]
        best = np.empty(len(starts), dtype=np.int32)
        w = 0
        while w < len(starts):
            v = max(w + 1, int(np.searchsorted(starts, starts[w] + WEIGHED)))
            a, b = starts[w], starts[v] if v < len(starts) else len(key)
            gain = gains(double, classes, now[w:v], np.repeat(np.arange(v - w), np.diff(np.append(starts[w:v], b))), code[a:b], n[a:b])
            stays = (now[w:v] >= 1) & (now[w:v] <= classes)
            here = np.flatnonzero(stays)
            gain[here, now[w:v][here] - 1] += 1e-9
            best[w:v] = gain.argmax(axis=1) + 1
            w = v
        more = times > 1
        return pa.table({"key": pa.array(key[starts][more]), "klass": pa.array(best[more], pa.int32())})

    return neighbours.groupBy("bucket").applyInArrow(run, "key long, klass int")


def token_pairs(train: DataFrame, hot: Hot, size: int, *, text_col: str | None = "text") -> np.ndarray:
    """Counts of neighbouring classes over all training tokens, where the frequent words' units are their classes and all other words are of the last one."""
    shared, coded = train.sparkSession.sparkContext.broadcast(hot), text_col is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for at, keys in _placed(batch, shared.value, coded):
                klass = np.where(keys == END_KEY, 0, np.where(at >= 0, shared.value.units[at] if len(shared.value.units) else 0, size - 1))
                total += np.bincount(np.concatenate([[0], klass[:-1]]) * size + klass, minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(size * size)
    for pair, n in _read_from(train, text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(size, size)


@dataclass
class Known:
    """What is known of words before transitions: the frequent words (their units are classes), tokens by class, and the part of words seen once that stands for unseen ones."""

    hot: Hot
    rare: int
    in_class: np.ndarray
    unseen: float

    @property
    def rare_tokens(self) -> int:
        """Training tokens of words seen once."""
        return int(self.in_class[self.rare])


@dataclass
class Model(Known):
    """What scoring needs on the executors: bounded by the frequent words and classes."""

    transition: np.ndarray


def codes(docs: DataFrame, hot: Hot, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """Rows with the columns ``keep`` and the ``codes`` of their tokens: the place of a frequent word, or below 0 the place (-1 the first) of its key in ``others``; a ``__row`` numbers them. Written, so that texts are split into words once for all that reads them."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for keys, lengths in tokens(batch.column(batch.num_columns - 1)):
                codes = shared.value.find(keys).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                other = np.flatnonzero(codes < 0)
                cuts = np.searchsorted(other, ends)
                words, sizes = [], [0]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    here = other[a:b]
                    own, at = np.unique(keys[here], return_inverse=True)
                    codes[here] = -1 - at
                    words.append(own)
                    sizes.append(sizes[-1] + len(own))
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)), pa.ListArray.from_arrays(pa.array(np.array(sizes, dtype=np.int32)), pa.array(np.concatenate(words)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(lengths)) for c in range(len(keep))), *columns], names=[*keep, "codes", "others"])
                done += len(lengths)

    fields = [*(docs.schema[c] for c in keep), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("others", T.ArrayType(T.LongType()))]
    return written(docs.select(*keep, text_col).mapInArrow(run, T.StructType(fields)).withColumn("__row", F.monotonically_increasing_id()), "lm-codes")


def _coded_tokens(batch: pa.RecordBatch, hot: Hot) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place among the frequent words (-1: none) and key of each token of codes(), in pieces of whole texts."""
    for piece in _pieces(batch, batch.column("codes").value_lengths().to_numpy(zero_copy_only=False)):
        listed, others = piece.column("codes"), piece.column("others")
        at = listed.flatten().to_numpy()
        keys = np.append(hot.keys, 0)[np.maximum(at, -1)]
        other = np.flatnonzero(at < 0)
        if len(other):
            text = np.repeat(np.arange(piece.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))[other]
            base = np.concatenate([[0], np.cumsum(others.value_lengths().to_numpy(zero_copy_only=False))])
            keys[other] = others.flatten().to_numpy()[base[text] - 1 - at[other]]
        yield np.maximum(at, -1), keys


def looked_up(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows of codes() with ``found`` instead of ``others``: ``j``, ``klass`` and ``n`` from the lexicon (``key``, ``klass``, ``n``) of the row's different words that are not frequent.

    Unseen words are missing. A text names such a word once. Where one of them stands in very many texts, the adaptive skew join splits its rows.
    """
    looked = rows.select("__row", F.posexplode("others").alias("j", "key")).join(lexicon, "key")
    found = looked.groupBy("__row").agg(F.collect_list(F.struct("j", "klass", "n")).alias("found"))
    return rows.drop("others").join(found, "__row", "left").drop("__row")


def _read(batch: pa.RecordBatch, hot: Hot, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per text; and of each token its class and count (0: unseen)."""
    codes, found = batch.column("codes"), batch.column("found")
    lengths = codes.value_lengths().to_numpy(zero_copy_only=False)
    at = codes.flatten().to_numpy()
    klass, n = (np.append(x, 0)[np.maximum(at, -1)] for x in (hot.units, hot.counts))
    other = np.flatnonzero(at < 0)
    if len(other):
        text = np.repeat(np.arange(len(lengths)), lengths)[other]
        widest = np.zeros(len(lengths), dtype=np.int64)
        np.maximum.at(widest, text, -at[other].astype(np.int64))
        base = np.concatenate([[0], np.cumsum(widest)])
        classes, counts = np.full(base[-1], rare), np.zeros(base[-1], dtype=np.int64)
        flat = found.flatten()
        place = np.repeat(base[:-1], found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + flat.field("j").to_numpy()
        classes[place], counts[place] = flat.field("klass").to_numpy(), flat.field("n").to_numpy()
        slot = base[text] - 1 - at[other]
        klass[other], n[other] = classes[slot], counts[slot]
    return lengths, klass, n


def _pieces(batch: pa.RecordBatch, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of whole texts, about 2**18 tokens each."""
    piece = np.cumsum(lengths) >> 18
    cuts = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
        yield batch.slice(a, b - a)


def sequences(docs: DataFrame, known: Known, lexicon: DataFrame, keep: tuple[str, ...] = (), *, text_col: str | None = "text") -> DataFrame:
    """Of texts, or of their codes() by the frequent words of ``known`` (``text_col`` None), each row's columns ``keep``, ``n_tokens``, ``n_known``, ``base_score``, ``emission`` (log10) and packed ``classes`` of its tokens, written."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names, kind = ["n_tokens", "n_known", "base_score", "emission", "classes"], _class_type(known.rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        floor = float(np.log10(m.hot.n_tokens + m.hot.n_types + 1))
        mass = np.where(np.arange(m.rare + 1) == m.rare, 1 - m.unseen, 1.0)
        for batch in batches:
            for piece in _pieces(batch, batch.column("codes").value_lengths().to_numpy(zero_copy_only=False)):
                lengths, klass, n = _read(piece, m.hot, m.rare)
                ends = np.cumsum(lengths)
                starts = np.concatenate([[0], ends[:-1]])
                emission = np.log10(np.where(n > 0, mass[klass] * np.maximum(n, 1) / np.maximum(m.in_class[klass], 1), m.unseen))
                emission[klass == 0] = 0.0
                base = np.add.reduceat(np.log10(n + 1.0), starts) - lengths * floor
                packed = klass.astype(kind).tobytes()
                classes = [packed[a * kind().itemsize : b * kind().itemsize] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)), pa.array(base), pa.array(np.add.reduceat(emission, starts)), pa.array(classes, type=pa.binary())]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *columns], names=[*keep, *names])

    fields = [*(docs.schema[c] for c in keep), *(T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BinaryType()), strict=True))]
    rows = docs if text_col is None else codes(docs, known.hot, keep, text_col)
    return written(looked_up(rows, lexicon).select(*keep, "codes", "found").mapInArrow(run, T.StructType(fields)), "lm-rows")


def _class_type(rare: int) -> type:
    return np.uint8 if rare < 256 else np.int32


def _class_steps(batch: pa.RecordBatch, rare: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of sequences(): the rows, their numbers of tokens, and of each token the class before it and its own."""
    for piece in _pieces(batch, batch.column("n_tokens").to_numpy()):
        klass = np.frombuffer(b"".join(piece.column("classes").to_pylist()), dtype=_class_type(rare)).astype(np.int64)
        yield piece, piece.column("n_tokens").to_numpy(), np.concatenate([[0], klass[:-1]]), klass


def class_pairs(rows: DataFrame, rare: int) -> np.ndarray:
    """Counts of neighbouring classes over all tokens of sequences()."""
    size = rare + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for _, _, before, klass in _class_steps(batch, rare):
                total += np.bincount(before * size + klass, minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(size * size)
    for pair, n in rows.select("n_tokens", "classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(size, size)


def _with_classes(hot: Hot, lexicon: DataFrame, rare: int) -> Hot:
    """The frequent words with their classes in the lexicon as units."""
    units = np.empty(len(hot.keys), dtype=np.int32)
    if len(units):
        found = lexicon.where(F.col("n") >= int(hot.counts.min())).select("key", "klass").toArrow()
        units[np.searchsorted(hot.keys, found.column("key").to_numpy())] = found.column("klass").to_numpy()
    return Hot(hot.keys, hot.counts, units, rare - 1 - OCTAVES, hot.n_tokens, hot.n_types, hot.n_once)  # words that aren't frequent: the class of rare ones


def word_classes(train: DataFrame, *, text_col: str = "text", classes: int = 32, exchange_words: int = 512, hot_limit: int = 1 << 20, sweeps: int = 10, moves: int = 1, coder: Callable[[Hot], DataFrame] | None = None) -> tuple[Known, DataFrame]:
    """What is known of the training words, and the written lexicon of all of them: ``key``, ``n`` and ``klass``.

    The ``exchange_words`` most frequent words are settled by ``sweeps`` of exchange in one process. Every other recurring word then takes its best class, and
    may move again in ``moves`` distributed sweeps, in which all of them are weighed against the classes that the sweep began with. ``coder`` gives the codes() of the
    training texts by the frequent words; without it they are made here.
    """
    counts = written(word_counts(train, text_col=text_col), "word-counts")
    hot = hot_words(counts, hot_limit, exchange_words)
    rows = codes(train, hot, (), text_col) if coder is None else coder(hot)
    pairs = unit_pairs(rows, hot, text_col=None)
    rare = classes + 1
    label = np.minimum(exchange_classes(pairs, exchange_words, classes, sweeps), rare)  # all other words: one class until they have theirs
    member = np.zeros((len(label), rare + 1))
    member[np.arange(len(label)), label] = 1
    table = member.T @ pairs @ member
    moved = (hot.units <= exchange_words) & (hot.units > 0)
    fixed = hot.keys[moved]
    seeds = train.sparkSession.createDataFrame(pa.table({"key": pa.array(fixed), "seed": pa.array(label[hot.units[moved]].astype(np.int32))}))
    now, lexicon = hot, counts.withColumn("klass", F.lit(None).cast("int"))
    for k in range(moves + 1):
        assigned = best_classes(neighbour_counts(rows, now, label, fixed, text_col=None), table, classes, now, label).withColumnRenamed("klass", "best")
        kept = lexicon.join(assigned, "key", "left").join(F.broadcast(seeds), "key", "left")
        klass = F.when(F.col("key") == END_KEY, 0).otherwise(F.coalesce("seed", F.when(F.col("n") > 1, F.coalesce("best", "klass")), F.lit(rare)))
        lexicon = written(kept.select("key", "n", klass.cast("int").alias("klass")), "lexicon")
        now = _with_classes(hot, lexicon, rare)
        if k < moves:
            label, table = np.arange(rare + 1), token_pairs(rows, now, rare + 1, text_col=None)
    hot, units = now, now.units
    in_class = np.zeros(rare + 1, dtype=np.int64)
    for k, n in lexicon.groupBy("klass").agg(F.sum("n")).collect():
        in_class[k] = n
    keys, n = hot.keys, hot.counts
    if END_KEY not in keys:  # the end is always among them, unseen too
        at = int(np.searchsorted(keys, END_KEY))
        keys, n, units = np.insert(keys, at, END_KEY), np.insert(n, at, in_class[0]), np.insert(units, at, 0)
    hot = Hot(keys, n, units, rare - 1 - OCTAVES, hot.n_tokens, hot.n_types, hot.n_once)
    rare_tokens = int(in_class[rare])
    unseen = hot.n_once / (rare_tokens + hot.n_once) if hot.n_once else (0.0 if rare_tokens else 1.0)
    return Known(hot, rare, in_class, max(unseen, 1 / (rare_tokens + 2))), lexicon


def with_transitions(known: Known, table: np.ndarray, prior: float) -> Model:
    """The model with smoothed log10 transitions from counts of neighbouring classes."""
    table, rare = table.copy(), known.rare
    double = 1 + known.hot.n_once / max(known.rare_tokens, 1)
    table[:, rare] *= double
    table[rare] *= double
    in_use = known.in_class > 0
    in_use[[0, rare]] = True  # a class without words has no probability
    share = (table.sum(axis=0) + 1) * in_use / (table.sum() + in_use.sum())
    with np.errstate(divide="ignore"):
        transition = np.log10((table + prior * share) / (table.sum(axis=1, keepdims=True) + prior))
    return Model(known.hot, rare, known.in_class, known.unseen, transition)


def fit(train: DataFrame, *, text_col: str = "text", prior: float = 16.0, **options) -> tuple[Model, DataFrame]:
    """The model, and the written lexicon of all words: ``key``, ``n`` and ``klass``. For ``options`` see word_classes()."""
    known, lexicon = word_classes(train, text_col=text_col, **options)
    return with_transitions(known, class_pairs(sequences(train, known, lexicon, text_col=text_col), known.rare), prior), lexicon


def scored(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    """Rows of sequences() with their scores."""
    shared, n_tokens = rows.sparkSession.sparkContext.broadcast(model.transition), model.hot.n_tokens
    rare = model.rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, lengths, before, klass in _class_steps(batch, rare):
                steps = np.add.reduceat(shared.value[before, klass], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                total = steps + piece.column("emission").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(id_col), piece.column("n_tokens"), piece.column("n_known"), pa.array(np.full(len(lengths), n_tokens, dtype=np.int64)), piece.column("base_score"), pa.array(total)],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    fields = [rows.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    return rows.mapInArrow(run, T.StructType(fields))


def score(docs: DataFrame, model: Model, lexicon: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``, log10, for every row.

    Null and empty texts are the end token alone. A very long text is read whole, its tokens in one row. Null ids and repeated
    rows stay. Other columns don't pass. With no training text every token is unseen and every score 0.
    """
    return scored(sequences(docs, model, lexicon, (id_col,), text_col=text_col), model, id_col)


def fit_and_score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", prior: float = 16.0, **options) -> DataFrame:
    """score() of all ``docs`` by the model that fit() finds on the rows where ``train`` holds; the words of a text are looked up once for both."""
    made: dict[str, DataFrame] = {}
    flagged = docs.select(id_col, text_col, train.alias("__train"))

    def coder(hot: Hot) -> DataFrame:
        made["rows"], made["words"] = codes(flagged, hot, (id_col, "__train"), text_col), len(hot.keys)
        return made["rows"].where("__train")

    known, lexicon = word_classes(docs.where(train), text_col=text_col, coder=coder, **options)
    same = len(known.hot.keys) == made["words"]  # else the end, which few texts have, came in and moved the places
    rows = sequences(made["rows"] if same else flagged, known, lexicon, (id_col, "__train"), text_col=None if same else text_col)
    return scored(rows, with_transitions(known, class_pairs(rows.where("__train"), known.rare), prior), id_col)
