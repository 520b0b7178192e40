from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, line_dedup, queries, simhash, token_counts
from gridloom.session import scratch_path, table

RANKS = byte_bpe.read_ranks(queries.token_file("byte_bpe_multi_50k.tiktoken"))
LONG = "passage of words that is long enough to be a key "
CLASHING = "doc_id long, text string, n_lines int, n_dropped string, ids string, n_tokens string, fp string, score string, digest string, key string"


def clashing(spark, rows):
    """Documents with columns named like those that the operators add."""
    return spark.createDataFrame([(i, t, 7, "x", "x", "x", "x", "x", "x", "x") for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def edge_rows():
    return [(1, None), (2, ""), (3, "a\n\n b"), (None, "no id"), (4, "word " * 30_000), (5, "same text"), (5, "same text"), (6, "same text"), (7, "é中\U0001f600 <|endoftext|> \x00\x1c end"), (8, " \t\r\n\x0b\x0c")]


def library():
    tokens = byte_bpe.parse_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def encoded_and_decoded(codec, texts):
    """Ids and bytes of texts by one codec, all slices together."""
    slices = list(codec.encode(pa.array(texts, type=pa.string())))
    return [i for s in slices for i in s.to_pylist()], [t for s in slices for part in byte_bpe.joined_tokens(codec.pieces, s) for t in part.to_pylist()]


@pytest.mark.parametrize("size", [byte_bpe.SLICE, 300])
def test_byte_bpe_equals_library_on_random_texts(monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "SLICE", size)
    codec, own, rnd = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, byte_bpe.stand_ins(public_tokenizers.PATTERN)), library(), random.Random(3)
    parts = ["the", " and", "'s", "'ll", "  ", " ", "\n", "\t", "\u00a0", "\u3000", "՘", "Ꟛ", "\U00018da0", "12", "٣", "!?", "üñ", "中", "\U0001f600", "\x00", "\x1c", "\ue000", "ÿ", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(3000)] + ["x" * 100_000, " " * 5000, "ab " * 20_000, "", None]
    for text, ids, back in zip(texts, *encoded_and_decoded(codec, texts), strict=True):
        assert ids == own.encode_ordinary(text or "")
        assert back == (text or "").encode()


def test_byte_bpe_rejects_patterns_over_spaces():
    with pytest.raises(ValueError):
        list(byte_bpe.Codec(RANKS, r"\S+ \S+|\s+|\S+").encode(pa.array(["one two three four"])))


def test_byte_bpe_rejects_bad_ranks():
    with pytest.raises(ValueError):
        byte_bpe.parse_ranks(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.parse_ranks(b"YQ== 0\nYg== 1\n")


def test_byte_bpe_round_trip(spark, edge_rows):
    own = library()
    encoded = byte_bpe.encode(clashing(spark, edge_rows), RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    both = byte_bpe.encode(clashing(spark, edge_rows), RANKS, public_tokenizers.PATTERN, extra=("text", "fp"), decoded_col="back")
    assert both.columns == ["doc_id", "fp", "text", "ids", "back"] and all(bytes(r.back) == (r.text or "").encode() and r.ids == own.encode_ordinary(r.text or "") for r in both.collect())
    found = byte_bpe.decode(encoded.withColumn("decoded", F.lit("old")), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.decoded), tuple(r.ids)) for r in found) == Counter((i, (t or "").encode(), tuple(own.encode_ordinary(t or ""))) for i, t in edge_rows)
    assert byte_bpe.decode(byte_bpe.encode(clashing(spark, []), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def test_op10(spark, sf_dir):
    own = library()
    found = {r.doc_id: r for r in queries.op10_byte_bpe(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").collect()
    assert len(found) == len(rows)
    for d in rows:
        ids = own.encode_ordinary(d.text or "")
        assert found[d.doc_id][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_token_counts_and_cache(spark, edge_rows):
    with open(queries.token_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    own, cache = sentencepiece.SentencePieceProcessor(model_proto=model), scratch_path(spark, "cache")
    docs = clashing(spark, edge_rows)
    want = Counter((i, len((t or "").encode()), len(own.encode(t or ""))) for i, t in edge_rows)
    assert Counter(map(tuple, token_counts.token_counts(docs, model, cache).collect())) == want
    stored = token_counts.stored_counts(spark, cache, token_counts.version_digest(model))
    assert stored.count() == len({t or "" for _, t in edge_rows})
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "a new text"), (10, "same text")], "doc_id long, text string"))
    files = spark.read.parquet(cache).count()
    assert Counter(map(tuple, token_counts.token_counts(more, model, cache).collect())) == want + Counter([(9, 10, len(own.encode("a new text"))), (10, 9, len(own.encode("same text")))])
    assert spark.read.parquet(cache).count() == files + 1  # the one text that missed
    assert token_counts.token_counts(clashing(spark, []), model, cache).collect() == []


def test_op2(spark, sf_dir):
    own = sentencepiece.SentencePieceProcessor(model_file=queries.token_file("piece_bpe_32k.model"))
    want = {(d.doc_id, len((d.text or "").encode()), n, n > 4096) for d in table(spark, sf_dir, "documents").collect() for n in [len(own.encode(d.text or ""))]}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf_dir).collect()} == want


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else []:
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_line_dedup_equals_brute_force(spark, edge_rows):
    rnd = random.Random(5)
    pool = [f"{LONG}{k}" for k in range(12)] + ["é" * 40, "é" * 39, "  " + LONG.upper() + "1\t", LONG + "1", "short", ""]
    rows = edge_rows + [(100 + d, "\n".join(rnd.choices(pool, k=rnd.randint(1, 8)))) for d in range(60)] + [(100, pool[0]), (None, pool[0])]
    found = line_dedup.dedup_lines(clashing(spark, rows))
    assert found.columns[-2:] == ["n_lines", "n_dropped"] and "ids" in found.columns
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(clashing(spark, [])).collect() == []


def test_line_dedup_with_full_filter(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 1 << 12)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1 << 12)
    rows = [(d, "\n".join(f"{LONG}{(d * 7 + k * k) % 900}" for k in range(40))) for d in range(80)]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_lines(rows)


def test_twice_seen_filter_misses_no_repeat():
    keys = [f"key {i}".encode() for i in range(3000)]
    h, bits = line_dedup._hashes(keys), 1 << 20
    filled = np.zeros(bits // line_dedup.RANGES // 8, dtype=np.uint8)
    line_dedup._add(filled, line_dedup._probes(h[:1500], bits))
    seen = line_dedup._seen(filled, line_dedup._probes(h, bits))
    assert seen[:1500].all() and seen[1500:].mean() < 0.2


def test_op3(spark, sf_dir, same_rows):
    same_rows(queries.op3_line_dedup(spark, sf_dir), queries.ORACLE_SQL["op3_line_dedup"])


def brute_simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, diff=2):
    """fp -> least fp reachable over links, by all pairs."""
    left, out = set(prints), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= diff}
            left -= near
            todo += near
        out.update(dict.fromkeys(group, min(group)))
    return out


def test_simhash_fingerprints(spark, edge_rows):
    found = simhash.fingerprints(clashing(spark, edge_rows)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in found) == Counter((i, brute_simhash(t or "")) for i, t in edge_rows)


@pytest.mark.parametrize("pairwise", [256, 2])
def test_simhash_links_lose_none(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rnd = random.Random(11)
    seeds = [rnd.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for s in seeds:
        x = s
        for _ in range(rnd.randint(0, 12)):
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints |= {seeds[0] ^ (a << 8 | b) for a in range(0, 16) for b in range(0, 16)}  # one dense group
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    edges = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(frame).collect()]
    want = brute_components(prints)
    joined = {x: x for x in prints}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        joined[max(a, b)] = min(a, b)
    assert {x: root(x) for x in prints} == want


@pytest.mark.parametrize("pairwise", [256, 2])
def test_tally_retains_and_verifies(monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    fps = np.array([0, 1, 3, 0x0100, 0x0F0F, 0x0103, 0x010101], dtype=np.uint64)
    assert simhash.tally(fps[:1], fps).tolist() == [8, 7, 7, 7, 6, 6, 5]
    counts = Counter()
    simhash.star(np.sort(fps), 2, counts)
    pairs = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :]]
    shared = [sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8)) for a, b in pairs]
    near = sum((a ^ b).bit_count() <= 2 for a, b in pairs)
    assert counts["verified"] == near and counts["candidates"] >= counts["retained"] >= near
    if pairwise == 256:
        assert counts["candidates"] == len(pairs) and counts["retained"] == sum(n >= 6 for n in shared) < len(pairs)


@pytest.mark.parametrize("max_diff", [1, 2, 3, 5])
def test_near_fingerprints_share_a_list(max_diff):
    rnd, kept = random.Random(max_diff), len(simhash.blocks(max_diff)) - max_diff
    assert sorted(p for b in simhash.blocks(max_diff) for p in b) == list(range(8)) and kept > 0
    for _ in range(200):
        change = simhash.mask([])
        for bit in rnd.sample(range(64), max_diff):
            change |= 1 << bit
        assert sum(change & simhash.mask(b) == 0 for b in simhash.blocks(max_diff)) >= kept


@pytest.mark.parametrize("long", [1 << 16, 5])
def test_tally_removes_candidates_and_long_lists_are_dealt(spark, monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG", long)
    rnd = random.Random(long)
    fps = {rnd.getrandbits(64) & ~0xFFFF | rnd.getrandbits(5) for _ in range(30)} | {0xABCD << 48 | 0x1234 << 32 | rnd.getrandbits(12) for _ in range(120)} | {rnd.getrandbits(32) << 32 | 7 for _ in range(40)}
    fps |= {f ^ (1 << rnd.randrange(64)) for f in rnd.sample(sorted(fps), 30)} | {f ^ (3 << rnd.randrange(63)) for f in rnd.sample(sorted(fps), 30)}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp long")
    edges = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(frame).collect()]
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in edges:
        group[max(root(a), root(b))] = min(root(a), root(b))
    want = brute_components(fps)
    assert {f: root(f) for f in fps} == {f: min(g for g in fps if want[g] == want[f]) for f in fps}
    counts = Counter()
    simhash.star(np.array(sorted(f for f in fps if f >> 32 == 0xABCD1234), dtype=np.uint64), 2, counts)
    assert counts["candidates"] > counts["retained"] > counts["verified"] > 0


def test_frequent_fingerprint_stays_spread(spark):
    rows = [(i, "the same text everywhere here") for i in range(3000)] + [(3000 + i, f"a text of its own {i} {i * 7}") for i in range(300)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert found.count() == 3300 and max(r["count"] for r in sizes) < 3000 and {r.component_id for r in found.where("doc_id < 3000").collect()} == {0}


def test_star_of_long_list_equals_pairs(monkeypatch):
    rnd = np.random.default_rng(2)
    fps = np.unique(rnd.choice(1 << 16, size=700, replace=False).astype(np.uint64) | np.uint64(1 << 40))
    monkeypatch.setattr(simhash, "PAIRWISE", 10_000)
    a = simhash.star(fps, 2)
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    b = simhash.star(fps, 2)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(a[0])


def test_near_duplicates_of_planted_copies(spark, edge_rows):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(5000)}" for _ in range(900)]
    near = words[:]
    near[450] = "changed"
    rows = edge_rows + [(50, " ".join(words)), (51, " ".join(near)), (52, "  ".join(words).upper()), (None, " ".join(words)), (60, "quite another text of a few words")]
    found = simhash.near_duplicates(clashing(spark, rows)).collect()
    prints = {brute_simhash(t or "") for _, t in rows}
    group = brute_components(prints)
    least: dict[int, int] = {}
    for i, t in rows:
        if i is not None:
            k = group[brute_simhash(t or "")]
            least[k] = min(least.get(k, i), i)
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((i, least.get(group[brute_simhash(t or "")])) for i, t in rows)
    assert {r.component_id for r in found if r.doc_id in (50, 52)} == {50}
    assert simhash.near_duplicates(clashing(spark, [])).collect() == []


def test_op7(spark, sf_dir):
    rows = {d.doc_id: brute_simhash(d.text or "") for d in table(spark, sf_dir, "documents").collect()}
    group, least = brute_components(set(rows.values())), {}
    for i, f in rows.items():
        least[group[f]] = min(least.get(group[f], i), i)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf_dir).collect()}
    assert found == {i: (f"{f:016x}", least[group[f]]) for i, f in rows.items()}
