"""Quality rules: counts of each text, and the hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

DataFrame functions only. The n-grams of all raw and all trusted texts are counted by bucket (partial sums before the shuffle); a text's ratio is
read from an array of BUCKETS gains, whose size is fixed, so texts never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed to; the gains of all are 1 MB, whatever the corpus.
BUCKETS = 1 << 18
#: Raw n-grams that a bucket is smoothed by: a bucket rarely seen says little.
PRIOR = 10.0
#: Mean gain (nats for an n-gram) from which a text is kept: texts like the target's lie near 0, marked-up or shouted ones below -0.3.
LEAST_RATIO = -0.25
MICRO = 1_000_000
#: Bits that ids of trusted texts are hashed to (2 MB): when they are many, more texts are shuffled to the ids, with the same result.
BITS = 1 << 24
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _from(found: Column, n: int) -> Column:
    """An array from its element ``n`` (from 1) on."""
    return F.slice(found, F.lit(n), F.size(found))


def _part(found: Column, n: int, less: int) -> Column:
    """As many elements from ``n`` (from 1) on as the array has, less ``less``."""
    return F.slice(found, F.lit(n), F.greatest(F.size(found) - less, F.lit(0)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often (and in whatever inner function) it is used, also where a filter is pushed below."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """Words covered by three-word windows (an array of hashes, in order) that occur twice or more. Windows are sorted only where one does."""

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, _from(places, 2), lambda p, after: F.least(F.lit(3), F.coalesce(after - p, F.lit(3))))  # a window adds the words that the one before has not
        return F.aggregate(steps, F.lit(0), lambda a, n: a + n)

    def places(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))

    def count(own: Column) -> Column:
        pairs = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(_let(_let(pairs, places), covered))

    return _let(windows, count).cast("long")


def buckets(found: Column) -> Column:
    """Buckets of words and of pairs of neighbouring words: by c, the unsigned CRC-32 of a word's UTF-8 bytes, c mod BUCKETS and (1000003 c + c') mod BUCKETS."""

    def both(sums: Column) -> Column:
        pairs = F.zip_with(_part(sums, 1, 1), _part(sums, 2, 1), lambda a, b: ((a * 1_000_003 + b) % BUCKETS).cast("int"))
        return F.concat(F.transform(sums, lambda c: (c % BUCKETS).cast("int")), pairs)

    return _let(F.transform(found, lambda w: F.crc32(w.cast("binary"))), both)


def _perhaps(ids: DataFrame, key: Column) -> Column:
    """False only where a key is not among ``ids`` (one column): a bit of BITS for each hash, packed to one array of longs, whose size is fixed."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    marked = ids.select(place(F.col(ids.columns[0])).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, int(place % 64))").alias("bits"))
    every = ids.sparkSession.range(BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marked.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))
    at = place(key)
    return key.isNotNull() & (F.getbit(F.get(words.scalar(), F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)


def bucket_counts(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket``, ``raw`` and ``trusted``: n-grams of all texts, and of those whose id is in ``trusted`` (``id_col``).

    Only texts whose id may be trusted are shuffled to the ids; all others are counted where they are read. Null ids are never trusted.
    """
    ids = trusted.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    perhaps = _perhaps(ids, F.col("id"))
    some = rows.where(perhaps).join(ids.withColumn("trusted", F.lit(True)).hint("shuffle_hash"), "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    each = some.unionByName(rows.where(~perhaps).select("text", F.lit(False).alias("trusted")))
    found = each.select("trusted", F.explode(buckets(words(F.col("text")))).alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(F.col("trusted")).alias("trusted"))


def gains(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row with the array ``gains``: for each bucket floor(10^6 ln(p / q)) of the trusted against the raw multinomial.

    Both are smoothed by ``prior`` raw n-grams in each bucket: with the share s of n-grams that are trusted, p / q is
    (trusted + prior s) / ((raw + prior) s), so a bucket never seen has 0. Without any trusted n-gram all gains are 0.
    """
    share = counts.agg((F.sum("trusted") / F.sum("raw")).alias("share"))
    ratio = (F.col("trusted") + F.col("share") * prior) / ((F.col("raw") + prior) * F.col("share"))
    gain = F.when(F.col("share") > 0, F.floor(F.log(ratio) * MICRO)).cast("int")
    seen = counts.join(F.broadcast(share), how="cross").select("bucket", gain.alias("gain"))
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("gain"))
    each = seen.unionByName(every).groupBy("bucket").agg(F.sum(F.coalesce("gain", F.lit(0))).cast("int").alias("gain"))
    return each.agg(F.array_sort(F.collect_list(F.struct("bucket", "gain")))["gain"].alias("gains"))


def judge(docs: DataFrame, table: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """``id_col``, the counts, ``base_failed``, ``ratio`` and ``kept`` for every row; ``table`` is the row of gains().

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an
    earlier line; ``n_repeat_words``: words in three-word windows that the text holds twice or more (windows are told apart by 64-bit hashes).
    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. ``ratio``: mean gain of the n-grams in nats, 0 without any.
    ``kept``: not failed, and a ratio of ``least`` or more.

    Null and empty texts have no words and fail; null ids and repeated rows keep their rows; an empty table gives none. Texts of any length are
    judged whole, in their own row. Columns that aren't named don't pass, so none can clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))
    found = F.col("words")
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    counted = rows.select(
        "id", F.size(found).cast("long").alias("n_words"), F.aggregate(found, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), lines.alias("lines"), hashes.alias("hashes"), buckets(found).alias("buckets"),
    )
    h = F.col("hashes")
    windows = F.zip_with(F.zip_with(_part(h, 1, 2), _part(h, 2, 2), lambda a, b: F.xxhash64(a, b)), _part(h, 3, 2), lambda ab, c: F.xxhash64(ab, c))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get("gains", b))
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    summed = counted.select("id", "n_words", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"), repeated_words(windows).alias("n_repeat_words"), "buckets", table.select("gains").scalar().alias("gains"))
    judged = summed.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce(F.try_divide(total, F.size("buckets")) / MICRO, F.lit(0.0)).alias("ratio"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "ratio", (~failed & (F.col("ratio") >= least)).alias("kept"))
