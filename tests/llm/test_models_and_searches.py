from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_tree, class_lm, exact_topk, mixing, multi_index, nb_svm, queries
from gridloom.session import table

# ---------------------------------------------------------------- chat trees


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, rank double, leaf string, formatted string")


def read(df):
    return {(r.tree_id, r.leaf): r for r in df.select("tree_id", "leaf", "branch_rank", "branch_score", "n_turns", "formatted", "loss_spans", chat_tree.read_turns(F.col("formatted")).alias("turns"), chat_tree.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_reply_trees_rank_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 9.0), (1, 5, 3, "user", None, None), (1, 6, 99, "user", "orphan", 0.5), (2, 1, None, None, "x", 0.0), (None, 1, None, "user", "null tree", 0.0), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (3, 7, 2, "user", "below a cycle", 1.0), (4, None, None, "user", "no id", 0.0)]
    rows += [(2, 1, None, None, "x", 0.0)]  # a repeated row
    docs = messages(spark, [(*r, "old", "old") for r in rows])
    got = read(chat_tree.format_trees(docs, score_col="rank", branches=2))
    assert {k: (r.branch_rank, r.branch_score, [(t.role, t.text) for t in r.turns]) for k, r in got.items()} == {
        (1, 4): (1, 10.0, [("user", "q"), ("assistant", "a"), ("user", "c")]),
        (1, 5): (2, 5.0, [("user", "q"), ("assistant", "b"), ("user", "")]),
        (2, 1): (1, 0.0, [("", "x")]),
        (None, 1): (1, 0.0, [("user", "null tree")]),
    }
    assert chat_tree.format_trees(messages(spark, [])).collect() == []


def test_escaping_is_reversible(spark):
    rnd = random.Random(4)
    parts = ["<", "|", "\\", "<|", "<\\|", "<|im_end|>", "<|im_start|>", "\n", "%", "%0A", "%25", "a", "é", "\U0001f600", "assistant"]
    rows = [(i, 1 + k, k or None, rnd.choice(["user", "assistant", "a\nb", "<|x%"]), "".join(rnd.choices(parts, k=rnd.randint(0, 12)))) for i in range(150) for k in range(rnd.randint(1, 5))]
    got = read(chat_tree.format_trees(messages(spark, [(*r, None, None, None) for r in rows])))
    for i in range(150):
        own = [r for r in rows if r[0] == i]
        (found,) = [r for k, r in got.items() if k[0] == i]
        assert [(t.role, t.text) for t in found.turns] == [(r[3], r[4]) for r in own]
        assert found.loss == [r[4] for r in own if r[3] == "assistant"]
        assert found.formatted.count("<|") == 2 * len(own)
        assert all("<|" not in found.formatted[s.start : s.start + s.length] for s in found.loss_spans)


def test_only_cycles_and_long_texts(spark):
    assert chat_tree.format_trees(messages(spark, [(3, 1, 2, "user", "a", None, None, None), (3, 2, 1, "user", "b", None, None, None)])).collect() == []
    long = "<|im_end|> word " * 100_000
    (found,) = read(chat_tree.format_trees(messages(spark, [(1, 1, None, "user", long, None, None, None), (1, 2, 1, "assistant", long, None, None, None)]))).values()
    assert [t.text for t in found.turns] == [long, long] and found.loss == [long]


def test_deep_chain(spark):
    rows = [(1, k, k - 1 if k else None, "assistant", f"t{k}", None, None, None) for k in range(300)]
    (found,) = read(chat_tree.format_trees(messages(spark, rows))).values()
    assert [t.text for t in found.turns] == [f"t{k}" for k in range(300)]


def test_op4(spark, sf_dir, same_rows):
    same_rows(queries.op4_chat_format(spark, sf_dir), queries.ORACLE_SQL["op4_chat_format"])


# ---------------------------------------------------------------- vector searches


def vector_rows():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 8)).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [(1, rows[1][1])]  # many equal vectors, a repeated row
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [float("inf")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [1.0] * 5), (2006, []), (None, [1.0] * 8), (2020, [2.0] * 8)]
    return rows


def brute(rows, k, each, score, zero_ok):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and (zero_ok or any(v))}
    out = {}
    for i, v in fine:
        if i % each == 0:
            found = sorted(((score(v, w), j) for j, w in fine if j != i), key=lambda x: (-x[0], x[1]))
            out[i] = found[:k]
    return out


def test_exact_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    rows = vector_rows()
    quantised = lambda v: [math.floor(256 * x) for x in v]
    want = brute(rows, 5, 10, lambda v, w: sum(a * b for a, b in zip(quantised(v), quantised(w), strict=True)), True)
    frame = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, id int, vec string, key int")
    found = exact_topk.search(frame, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert got == want
    assert exact_topk.search(frame.limit(0), F.col("id") % 10 == 0).collect() == []
    assert exact_topk.search(frame.where("vec_id = 20"), F.col("id") % 10 == 0).collect() == []


def test_exact_topk_of_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-300_000, 300_000, 64)]) for i in range(40)] + [(100, [3e5] * 64), (120, [0.0] * 64), (140, [2.0**44 + 1] * 2 + [0.0] * 62)]
    quantised = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    frame = spark.createDataFrame([(i, v) for i, v in rows if i < 140], "vec_id long, embedding array<double>")
    got = {}
    for r in exact_topk.search(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    score = lambda a, b: sum(x * y for x, y in zip(quantised[a], quantised[b], strict=True))
    assert got == {q: sorted(((score(q, j), j) for j, _ in rows if j not in (q, 140)), key=lambda x: (-x[0], x[1]))[:5] for q in (0, 20, 100, 120)}
    wide = exact_topk.Lists(np.array([quantised[140], quantised[100], quantised[3]], dtype=np.int64))
    assert wide.top(np.array([1] * 64), 1)[1].tolist() == [2 * quantised[140][0]]
    assert wide.top(np.array(quantised[140]), 1)[1].tolist() == [2 * quantised[140][0] ** 2]  # beyond 64 bits


def test_commonest_length_takes_part(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in exact_topk.search(frame, F.col("id") % 20 == 0).collect()} == {(40, 1)}  # a tie of lengths: the longer
    assert {(r.query_id, r.vec_id) for r in multi_index.search(frame, F.col("id") % 20 == 0).collect()} == {(40, 1)}


def test_repeated_rows_inside_a_large_group_of_equal_vectors(spark):
    rows = [(i, [0.5, 0.25]) for i in range(40) for _ in range(25 if i == 0 else 2)] + [(100 + i, [0.01 * i, 0.2]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search, k in ((multi_index.search, 20), (exact_topk.search, 5)):
        got = {}
        for r in search(frame, F.col("id").isin(0, 39)).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {0: list(range(1, k + 1)), 39: list(range(k))}


def test_bounds_stop_before_the_lists_end():
    rng = np.random.default_rng(3)
    points = rng.integers(-50, 50, size=(3000, 4)).astype(float)
    points[:3] *= 40
    at, scores, read_ = exact_topk.Lists(points).top(points[0], 3)
    exact = points @ points[0]
    assert set(at[np.argsort(-scores)][:3]) == set(np.argsort(-exact)[:3]) and read_ < points.size


def test_multi_index_exact_when_all_is_visited(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARES", (1.0,))
    monkeypatch.setattr(multi_index, "BLOCK", 50)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 8)
    rows = vector_rows()
    want = brute(rows, 20, 20, lambda v, w: float(np.dot(v, w)), False)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, key string")
    got = {}
    for r in multi_index.search(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    assert got == {q: [(round(s, 9), j) for s, j in found] for q, found in want.items()}
    assert multi_index.search(frame.limit(0), F.col("id") % 20 == 0).collect() == []


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(1)
    books = multi_index.Codebooks(rng.normal(size=(6, 2)), rng.normal(size=(7, 2)))
    query, sizes = rng.normal(size=4), rng.integers(0, 5, size=(6, 7))
    cost = -(books.first @ query[:2])[:, None] - (books.second @ query[2:])[None, :]
    order = [divmod(int(x), 7) for x in np.argsort(cost, axis=None)]
    for wanted in (1, 20, 60, 10_000):
        left, want = wanted, np.zeros((6, 7), dtype=bool)
        for i, j in order:
            if left > 0 and sizes[i, j]:
                want[i, j] = True
                left -= sizes[i, j]
        assert (books.visit(query, sizes.tolist(), wanted) == want).all()


def test_op5_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in table(spark, sf, "embeddings").collect()}
    found = {}
    for r in queries.op5_multi_index(spark, sf).collect():
        assert abs(r.score - rows[r.query_id] @ rows[r.vec_id]) < 1e-9
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & set(sorted((i for i in rows if i != q), key=lambda i: (-(rows[q] @ rows[i]), i))[:20])) for q in rows if q % 20 == 0]
    assert sum(hits) / (20 * len(hits)) >= 0.9


def test_op6(spark, sf_dir, same_rows):
    same_rows(queries.op6_exact_topk(spark, sf_dir), queries.ORACLE_SQL["op6_exact_topk"])


# ---------------------------------------------------------------- classifier, language model, mixing


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = queries.op1_nb_svm(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "abc", "x"), (3, "word " * 50_000, "x"), (3, "twice", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    scored = nb_svm.score(docs, nb_svm.fit(docs, labels), extra=("text",)).collect()
    assert len(scored) == 5 and {r.score for r in scored} == {0.5}  # too few labels: the constant
    assert nb_svm.score(docs.limit(0), nb_svm.fit(docs, labels.limit(0))).collect() == []


def test_repeated_ids_and_bytes_bound_the_sample(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["good", "fine", "well"] if i % 2 else ["bad", "junk", "poor"], k=20))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once = nb_svm.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_rows=100)
    more = nb_svm.fit(spark.createDataFrame(rows * 3 + [(i, "zzz " + t) for i, t in rows], "doc_id long, text string").repartition(7), labels, max_rows=100)
    assert all(np.array_equal(getattr(once, f), getattr(more, f)) for f in ("weights", "squares", "curve"))
    few = nb_svm.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_bytes=1)
    assert not few.weights.any() and few.score([np.array([1])])[0] == 0.5


def test_ratios_and_weights_against_a_plain_fit():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 6) + (0 if i % 2 else 5)).astype(np.int32) for i in range(60)]
    labels = np.arange(60) % 2
    ratio = nb_svm.log_count_ratios(rows, labels)
    for place in range(17):
        p, q = (1 + sum(place in r for r, y in zip(rows, labels, strict=True) if y == c) for c in (1, 0))
        if p + q > 2:
            total = [nb_svm.PLACES + sum(len(r) for r, y in zip(rows, labels, strict=True) if y == c) for c in (1, 0)]
            assert abs(ratio[place] - math.log(p / total[0] / (q / total[1]))) < 1e-9
    values = [(ratio[r] / np.sqrt(ratio[r] @ ratio[r])).astype(np.float32) for r in rows]
    w, bias = nb_svm.dual_coordinate_descent(rows, values, labels, 1.0, 2000, 7)
    x, y = np.zeros((60, 18)), np.where(labels == 1, 1.0, -1.0)
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
    x[:, 17] = 1
    primal = lambda u: 0.5 * u @ u + np.maximum(0, 1 - y * (x @ u)).sum()
    found, best, u = np.append(w[:17], bias), np.inf, np.zeros(18)
    for t in range(1, 20_001):  # subgradient steps on the same objective
        u -= (u - (y * (y * (x @ u) < 1)) @ x) / (t + 10)
        best = min(best, primal(u))
    assert primal(found) <= 1.01 * best  # epochs end once no gradient exceeds 0.01


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12) + (0 if i % 2 else 25)).astype(np.int32) for i in range(200)]
    labels = np.arange(200) % 2
    model = nb_svm.fit_rows(rows, labels)
    scores = model.score(rows)
    assert ((scores > 0.5) == labels).mean() > 0.97


def brute_base(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    train = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return [(i, len(tokens(t)), sum(w in train for w in tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows]


@pytest.mark.parametrize("hot", [1 << 18, 3, 0])
def test_language_model_base_score(spark, hot):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["Aa", "bb", "cc", "dd", f"w{rnd.randrange(300)}"], k=rnd.randint(0, 30)))) for i in range(120)] + [(None, "aa zz"), (500, None), (500, "aa bb"), (2, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, key int")
    model, counts = class_lm.fit(docs.where(~class_lm.held_out("doc_id")), hot_limit=hot, exchange_words=8, classes=3)
    scored = class_lm.score(docs, model, counts).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == Counter(brute_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert np.allclose((10**model.transition).sum(axis=1), 1)


def test_language_model_sums_to_one_and_empty(spark):
    docs = spark.createDataFrame([(1, "a a b c"), (3, "a b b d")], "doc_id long, text string")
    model, counts = class_lm.fit(docs, exchange_words=2, classes=2)
    words = spark.createDataFrame([(k, w) for k, w in enumerate(["", "a", "b", "c", "d", "unseen"])], "doc_id long, text string")
    end = {r.doc_id: r.score for r in class_lm.score(words, model, counts).collect()}
    after = {w: 10 ** class_lm_first(model, counts, spark, w) for w in ["a", "b", "c", "d", "unseen"]}
    assert abs(sum(after.values()) + 10 ** end[0] - 1) < 1e-9
    nothing, none = class_lm.fit(docs.limit(0))
    assert [r.base_score for r in class_lm.score(docs, nothing, none).collect()] == [0.0, 0.0]
    assert class_lm.score(docs.limit(0), model, counts).collect() == []


def class_lm_first(model, counts, spark, word):
    """log10 P(word | start): the text's score less that of the end after the word's class."""
    total = class_lm.score(spark.createDataFrame([(1, word)], "doc_id long, text string"), model, counts).first().score
    key = class_lm._keys([word.encode()])
    _, unit = model.hot.units_of(key)
    return total - model.transition[unit[0], 0]


def test_class_scores_word_by_word(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choices(["Aa", "bb", "cc", f"w{rnd.randrange(60)}", f"x{i}"], k=rnd.randint(0, 25)))) for i in range(150)] + [(None, "aa zz"), (700, None), (701, "bb " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = class_lm.held_out("doc_id")
    _, lexicon = class_lm.word_classes(docs.where(~out), hot_limit=16, exchange_words=8, classes=3)
    known = {r.key: (r.klass, r.n) for r in lexicon.collect()}
    train = {tuple(r) for r in docs.where(~out).collect()}
    rare, once = 4, sum(n == 1 for _, n in known.values())

    def words(text):
        keys = class_lm._keys([*(w.encode() for w in (text or "").lower().split()), class_lm.END]).tolist()
        return [known.get(k, (rare, 0)) for k in keys]

    table, in_class = np.zeros((rare + 1, rare + 1)), np.zeros(rare + 1)
    for r in train:
        before = 0
        for k, _ in words(r[1]):
            table[before, k] += 1
            in_class[k] += 1
            before = k
    unseen, double = once / (in_class[rare] + once), 1 + once / in_class[rare]
    table[:, rare] *= double
    table[rare] *= double
    use = (in_class > 0) | np.isin(np.arange(rare + 1), [0, rare])
    share = (table.sum(axis=0) + 1) * use / (table.sum() + use.sum())
    want = Counter()
    for i, text in rows:
        total, before = 0.0, 0
        for k, n in words(text):
            total += math.log10((table[before, k] + 16 * share[k]) / (table[before].sum() + 16))
            total += math.log10(unseen if n == 0 else (1 - unseen if k == rare else 1) * n / in_class[k]) if k else 0.0
            before = k
        want[i, round(total, 6)] += 1
    found = class_lm.fit_and_score(docs, ~out, hot_limit=16, exchange_words=8, classes=3).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in found) == want
    apart = class_lm.score(docs, *class_lm.fit(docs.where(~out), hot_limit=16, exchange_words=8, classes=3)).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in apart) == want


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(5)
    groups = rng.integers(0, 3, 30)
    pairs = np.zeros((34, 34), dtype=np.int64)
    for _ in range(5000):
        a = rng.integers(0, 30)
        b = rng.choice(np.flatnonzero(groups == (groups[a] + 1) % 3))
        pairs[1 + a, 1 + b] += 1
    label = class_lm.exchange_classes(pairs, 30, 3)
    assert label[0] == 0 and len({(g, k) for g, k in zip(groups, label[1:31], strict=True)}) == 3  # finds the groups


def likelihood(text, of):
    """Bigram log likelihood of classes, up to what no move changes."""
    pairs, left, right = Counter(), Counter(), Counter()
    before = 0
    for w in text:
        k = 0 if w == "." else of[w]
        pairs[before, k] += 1
        left[before] += 1
        right[k] += 1
        before = k
    return sum(n * math.log(n) for n in pairs.values()) - sum(n * math.log(n) for c in (left, right) for n in c.values())


def test_gains_equal_a_single_process():
    rnd = random.Random(7)
    names = [f"w{i}" for i in range(12)]
    text = [rnd.choice([*names, "."]) for _ in range(900)] + ["w1"] * 9 + ["w2", "w2", "."]
    classes, of = 4, {w: 1 + i % 5 for i, w in enumerate(names)}  # 5: a class that no word may choose
    size = classes + 2
    k = np.array([0] + [0 if w == "." else of[w] for w in text])
    table = np.zeros((size, size))
    np.add.at(table, (k[:-1], k[1:]), 1)
    rows = Counter()
    for i, w in enumerate(text):
        if w != ".":
            rows[names.index(w), int(k[i + 2]) if i + 2 < len(k) else 0] += 1
            rows[names.index(w), size + int(k[i])] += 1
            if i + 1 < len(text) and text[i + 1] == w:
                rows[names.index(w), 2 * size] += 1
    entries = np.array([(w, c, n) for (w, c), n in sorted(rows.items())])
    gain = class_lm.gains(table, classes, np.array([of[w] for w in names]), *entries.T)
    for i, w in enumerate(names):
        moved = np.array([likelihood(text, of | {w: c}) for c in range(1, classes + 1)])
        assert np.allclose(gain[i] - gain[i][0], moved - moved[0], atol=1e-6), w


def test_a_sweep_moves_words_to_better_classes(spark):
    rnd = random.Random(4)
    kinds = [[f"{c}{i}" for i in range(25)] for c in "abcd"]
    texts = [" ".join(rnd.choice(kinds[k % 4]) for k in range(rnd.randint(4, 14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [w for t in texts for w in (*t.split(), ".")]
    scores = []
    for moves in (0, 1, 2):
        _, lexicon = class_lm.word_classes(docs, exchange_words=4, classes=6, sweeps=1, moves=moves)
        klass = {r.key: r.klass for r in lexicon.collect()}
        scores.append(likelihood(words, {w: klass[int(class_lm._keys([w.encode()])[0])] for w in set(words) - {"."}}))
    assert scores[1] >= scores[0] and scores[2] >= scores[0]


@pytest.mark.parametrize("hot", [8, 1 << 18])
def test_every_recurring_word_has_the_class_of_its_neighbours(spark, monkeypatch, hot):
    monkeypatch.setattr(class_lm, "RANGE_TOKENS", 50)
    texts = ["aa m bb"] * 60 + ["cc n dd"] * 50 + [f"aa a{i} bb" for i in range(40) for _ in range(2 + i % 9)] + [f"cc b{i} dd" for i in range(40) for _ in range(2 + i % 9)] + ["aa once bb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, lexicon = class_lm.fit(docs, hot_limit=hot, exchange_words=6, classes=6, sweeps=0)
    klass = {r.key: (r.klass, r.n) for r in lexicon.collect()}
    of = lambda w: klass[int(class_lm._keys([w.encode()])[0])]
    assert of("m")[0] != of("n")[0] and of("once") == (7, 1)
    assert [of(f"a{i}") for i in range(40)] == [(of("m")[0], 2 + i % 9) for i in range(40)]
    assert [of(f"b{i}") for i in range(40)] == [(of("n")[0], 2 + i % 9) for i in range(40)]
    assert model.in_class.sum() == sum(n for _, n in klass.values())
    assert model.in_class.tolist() == [sum(n for k, n in klass.values() if k == c) for c in range(8)]


def test_class_model_beats_unigrams_on_held_out(spark):
    rows = queries.op9_class_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_mixing_budgets_and_blocks(spark):
    rnd = random.Random(6)
    rows = [(i, "big" if i % 2 else rnd.choice(["s1", "s2", None, ""]), " ".join(["w"] * rnd.randint(0, 40)), "x") for i in range(400)] + [(None, "s1", None, "x"), (7, "big", "w w", "x"), (7, "big", "w w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_block string")
    for clash in ("tokens", "budget", "part", "start", "docs", "offset"):
        docs = docs.withColumn(clash, F.lit("x"))
    mixed = mixing.mix(docs, max_passes=1.5, block_tokens=500)
    assert mixed.columns[:4] == ["doc_id", "source", "text", "tokens"] and mixed.columns.count("mix_block") == 1
    found = mixed.collect()
    shown = Counter((r.doc_id, r.source, r.text) for r in found)
    once = Counter((i, s, t) for i, s, t, _ in rows)
    assert set(shown) == set(once) and all(shown[k] >= once[k] for k in once)  # every document at least once
    size: dict[str, int] = {}
    for _, s, t, _ in rows:
        size[s or ""] = size.get(s or "", 0) + len((t or "").split()) + 1
    total, weight = sum(size.values()), {r.source or "": r.mix_weight for r in found}
    exponent = found[0].mix_exponent
    powers = {s: (n / total) ** exponent for s, n in size.items()}
    assert all(abs(weight[s] - p / sum(powers.values())) < 1e-9 for s, p in powers.items())
    budget = max(n / weight[s] for s, n in size.items())
    for s, n in size.items():
        own = [r for r in found if (r.source or "") == s]
        got, wanted = sum(r.mix_tokens for r in own), round(weight[s] * budget)
        assert wanted <= got < wanted + max(r.mix_tokens for r in own)
        assert wanted <= 1.5 * n + 2
        blocks = Counter()
        for r in own:
            blocks[r.mix_block] += r.mix_tokens
        n_blocks = math.ceil(budget / 500)
        assert all(abs(blocks[b] - wanted / n_blocks) <= 2 * max(r.mix_tokens for r in own) for b in range(n_blocks))
    assert mixing.mix(docs.limit(0)).collect() == []


def brute_mix(rows, exponent, weights, tokens, block_tokens):
    """Showings by one pass over each source's rows (row key, order by pass, tokens) in order: key, pass and block."""
    out, blocks = Counter(), max(1, math.ceil(tokens / block_tokens))
    for source, own in rows.items():
        total, budget = sum(n for _, _, n in own), round(weights[source] * tokens)
        start, k = 0, 0
        while start < budget:
            for key, order, n in sorted(own, key=lambda r: (r[1][k], r[0])):
                if start < budget:
                    out[key, k, int(start / budget * blocks)] += 1
                start += n
            k += 1
    return out


def test_mixing_layout_equals_one_pass(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", "b", "b", "b", "c"]), " ".join(["w"] * rnd.randint(0, 60)) + f" {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs, max_passes=1.5, block_tokens=700).collect()
    weights, exponent = {r.source: r.mix_weight for r in found}, found[0].mix_exponent
    orders = {}
    for k in range(3):  # the order that the operator draws: a hash of pass, source, id and text
        drawn = F.xxhash64(F.lit(k), F.xxhash64(F.lit(5), "source", F.xxhash64("doc_id", "text")))
        for r in docs.select("doc_id", drawn.alias("o")).collect():
            orders.setdefault(r.doc_id, []).append(r.o % (1 << 64))  # unsigned, as ranges are
    by_source: dict[str, list] = {}
    for i, s, t in rows:
        by_source.setdefault(s, []).append((i, [o for o in orders[i]], len(t.split()) + 1))
    total = sum(n for own in by_source.values() for _, _, n in own)
    tokens = max(sum(n for _, _, n in own) / weights[s] for s, own in by_source.items())
    assert abs(sum(weights.values()) - 1) < 1e-9 and tokens <= 1.5 * total
    got = Counter((r.doc_id, r.mix_pass, r.mix_block) for r in found)
    signed = {s: [(i, [o - (1 << 64) if o >> 63 else o for o in os], n) for i, os, n in own] for s, own in by_source.items()}
    bits = (max(map(len, by_source.values())).bit_length() + 1) // 2
    ranged = {s: [(i, [((o % (1 << 64)) >> (64 - bits), o) for o in os], n) for i, os, n in own] for s, own in signed.items()}
    assert got == brute_mix(ranged, exponent, weights, tokens, 700)


def test_mixing_tells_null_ids_apart(spark):
    docs = spark.createDataFrame([(None, "s", "same")] * 300 + [(i, "s", f"t {i}") for i in range(100)], "doc_id long, source string, text string")
    found = mixing.mix(docs, max_passes=1.0).collect()
    assert len(found) == 400 and len({r.mix_order for r in found}) == 400


def test_mixing_meets_entropy(spark):
    docs = spark.createDataFrame([(i, f"s{min(i // 50, 2)}", "w " * 9) for i in range(400)], "doc_id long, source string, text string")
    found = mixing.mix(docs, entropy=0.9, max_passes=None).select("source", "mix_weight").distinct().collect()
    assert abs(-sum(r.mix_weight * math.log(r.mix_weight) for r in found) / math.log(3) - 0.9) < 1e-6
    same = mixing.mix(docs, max_passes=None, budget=2000).groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()
    assert abs(sum(r.n for r in same) - 2000) <= 30


def test_mixing_bisects_by_aggregation_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 7}", "w " * (i % 7 + 1)) for i in range(70)], "doc_id long, source string, text string")
    near = mixing.mix(docs, max_passes=1.3).first().mix_exponent
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
    assert abs(mixing.mix(docs, max_passes=1.3).first().mix_exponent - near) < 1e-9
