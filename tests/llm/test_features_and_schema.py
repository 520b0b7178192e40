from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance, json_schema, quality_rules, queries

NAMES = ("op11_importance_resampling", "op12_json_schema", "op13_quality_rules")
EDGES = [
    (1, None), (2, ""), (3, "a b c a b c x"), (None, "no id at all"), (4, "word " * 30_000), (5, "same text of a few words " * 12), (5, "same text of a few words " * 12),
    (6, "é中 \U0001f600 <|end|> \x00\x1c end #1 $2 a&b"), (7, " \t\r\n\x0b\x0c"), (8, "one line\n\none line\n one line\none line"), (9, " ".join(f"w{i}" for i in range(49))), (10, " ".join(f"W{i}" for i in range(50))),
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, same_rows, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


# ---------------------------------------------------------------- quality rules


def quality_counts(text):
    words, lines = re.findall("[^\x20\x09-\x0d]+", text or ""), [s for s in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + d for found in places.values() if len(found) > 1 for i in found for d in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return words, (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed)


def quality_rows(rows, trusted, least=quality_rules.LEAST_RATIO):
    grams = []
    for _, text in rows:
        words = quality_counts(text)[0]
        sums = [zlib.crc32(w.encode()) for w in words]
        grams.append([c % quality_rules.BUCKETS for c in [*sums, *(1_000_003 * a + b for a, b in zip(sums, sums[1:]))]])
    raw, good = Counter(b for g in grams for b in g), Counter(b for (i, _), g in zip(rows, grams) if i in trusted for b in g)
    share = sum(good.values()) / sum(raw.values()) if raw else 0
    gain = {b: math.floor(1e6 * math.log((good[b] + 10 * share) / ((raw[b] + 10) * share))) if share else 0 for b in raw}
    out = []
    for (i, text), g in zip(rows, grams):
        ratio = sum(gain[b] for b in g) / len(g) / 1e6 if g else 0.0
        counts = quality_counts(text)[1]
        out.append((i, *counts, not counts[-1] and ratio >= least, round(ratio, 9)))
    return out


@pytest.mark.parametrize("trusted", [{3, 10}, set(), {99}])
def test_quality_rules_equal_brute_force(spark, trusted):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"words": F.lit(1), "gains": F.lit("x"), "trusted": F.lit("x"), "ratio": F.lit("x"), "id": F.lit("x")})
    counts = quality_rules.bucket_counts(docs, spark.createDataFrame([(i,) for i in (*trusted, *trusted, None)], "doc_id long"))
    found = quality_rules.judge(docs, quality_rules.gains(counts))
    got = [(*r[:7], r["kept"], round(r["ratio"], 9)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(quality_rows(EDGES, trusted), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_rules_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(docs, quality_rules.gains(quality_rules.bucket_counts(docs, docs))).collect() == []


def test_quality_rules_keep_good_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    judged = queries.op13_quality_rules(spark, folder).where("NOT base_failed")
    assert judged.where("kept AND n_repeat_words < 5 AND ratio > -1").count() > 500  # filters are pushed down
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(queries.held_out_quarter())
    rows = judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in rows}
    assert share[1] >= 0.97 and share[0] <= 0.1


# ---------------------------------------------------------------- importance resampling


def resampled(rows, target, percent=25, least=20, buckets=10_000):
    def grams(text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])

    own, wanted = [grams(t) for _, t in rows], sum((grams(t)[1] for t in target), Counter())
    raw = sum((g for _, g in own), Counter())
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)}
    out = []
    for (i, _), (n, g) in zip(rows, own):
        size = sum(g.values())
        weight = sum(gain[b] * k for b, k in g.items()) // size if size else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, r in enumerate(drawn, 1):
        r.append(place if place <= percent * len(drawn) // 100 else None)
    return [(*r[:4], r[5] if r[4] else None) for r in out]


@pytest.mark.parametrize(("target", "percent"), [(["W1 w2 w3", "a b c", None, ""], 50), ([], 100)])
def test_importance_equals_brute_force(spark, target, percent):
    rows = [*EDGES, *((100 + i, f"word text {i} of A few words " * (i % 7)) for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "weight": F.lit("x"), "buckets": F.lit("x"), "place": F.lit("x")}).repartition(3)
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(resampled(rows, target, percent), key=repr)


def test_importance_slices_do_not_change_features(spark, monkeypatch):
    texts = spark.createDataFrame(EDGES, "doc_id long, text string").coalesce(1)
    whole = importance.features(texts, longest=3).collect()
    pieces = list(importance._slices(importance.pa.array([t for _, t in EDGES])))
    assert pieces == [(0, len(EDGES))]
    monkeypatch.setattr(importance, "SLICE", 8)
    assert [a for a, _ in importance._slices(importance.pa.array([t for _, t in EDGES]))][:3] == [0, 2, 3]
    assert [r["n_words"] for r in whole] == [len(re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for _, t in EDGES]


def test_importance_of_an_empty_table(spark):
    assert importance.resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")).collect() == []


# ---------------------------------------------------------------- nested schema


def schema_of(rows, most=12):
    """The contract, row by row: values of each depth together, names replaced before the next depth."""
    kinds = {type(None): "null", bool: "boolean", int: "integer", float: "double", str: "string", list: "array", dict: "object"}
    types, sizes, names, parents, maps, now = defaultdict(Counter), defaultdict(list), {}, {}, set(), []
    for click, client, props in rows:
        g = (client or 0) % 30
        x = zlib.crc32(("" if click is None else str(click)).encode()) % (g % 37 + 1)
        try:
            value = json.loads(props, parse_int=lambda s: 0, parse_constant=lambda s: 1 / 0) if props is not None else None
        except (ValueError, ZeroDivisionError):
            value = None
        if isinstance(value, dict):
            now.append(("$", None, {f"g{g}": {f"x{x}": [value] if click is not None and click % 5 == 0 else value}}))
        else:
            types[f"!g{g}"]["bad"] += 1
    while now:
        shown = defaultdict(set)
        for path, parent, v in now:
            types[path][kinds[type(v)]] += 1
            parents[path] = parent
            if isinstance(v, dict):
                shown[path] |= v.keys()
            if isinstance(v, list):
                sizes[path].append(len(v))
        names |= {p: len(k) for p, k in shown.items()}
        maps |= {p for p, k in shown.items() if p != "$" and len(k) > most}
        later = []
        for path, _, v in now:
            if isinstance(v, dict):
                later += [(f"{path}.*" if path in maps or k == "*" else f"{path}.{k}", None if path in maps or k == "*" else path, x) for k, x in v.items()]
            elif isinstance(v, list):
                later += [(f"{path}[]", None, x) for x in v]
        now = later
    out = []
    for path, found in types.items():
        held, parent = sum(found.values()) - found["null"], parents.get(path)
        listed = "|".join(f"{k}:{n}" for k, n in sorted(found.items()) if n)
        out.append((path, listed, names.get(path, 0), path in maps, parent is not None and held < types[parent]["object"], min(sizes[path], default=None), max(sizes[path], default=None)))
    return out


CLICKS = [
    (0, 1, '{"k": 1, "a.b": {"c": null}, "c": [1, 2.5, [], {"z": true}]}'), (1, 1, '{"k": 1e3}'), (2, 1, '{"k": 12345678901234567890123}'), (3, None, None), (4, 2, "[1]"), (5, 2, '{"k": 1'), (6, 2, ' {"k": "x", "k": null} '),
    (7, 3, "{}"), (10, 3, "{}"), (8, 3, '{"a": {"b": {"c": [[{"d": -0}]]}}}'), (9, 40, '{"n": NaN}'), (None, None, '{"*": 1, "é": "\\ud800", "\\u0000": false}'), (11, 4, ""), (12, 4, "null"), (13, 4, '{"k": ' + "9" * 5000 + "}"),
    *((i, 5, json.dumps({f"n{i % 20}": {"v": i, f"w{i}": [i] * (i % 3)}, "m": {f"o{i % 12}": 1}})) for i in range(20, 60)), *((i, 29, '{"k": 1, "t": [{"q": 1}, null]}') for i in range(60, 200)), (7, 3, "{}"), (7, 3, "{}"),
]


def test_schema_equals_brute_force(spark):
    rows = spark.createDataFrame(CLICKS, "click_id long, client_id long, props string").withColumns({"steps": F.lit(1), "path": F.lit("x"), "n": F.lit("x"), "type": F.lit("x"), "text": F.lit("x")}).repartition(3)
    rows.write.mode("overwrite").parquet(f"{queries.scratch_path(spark, 'clicks')}/clicks.parquet")
    client, click = F.coalesce(F.pmod("client_id", F.lit(30)), F.lit(0)), F.coalesce(F.col("click_id").cast("string"), F.lit(""))
    found = json_schema.infer(rows, text=F.col("props"), group=F.concat(F.lit("g"), client), inner=F.concat(F.lit("x"), F.pmod(F.crc32(click.cast("binary")), client % 37 + 1)), wrap=F.col("click_id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(schema_of(CLICKS))


def test_schema_of_nothing_and_of_broken_texts(spark):
    empty = spark.createDataFrame([], "t string")
    place = {"text": F.col("t"), "group": F.lit("g"), "inner": F.lit(None), "wrap": F.lit(None).cast("boolean")}
    assert json_schema.infer(empty, **place).collect() == []
    broken = spark.createDataFrame([("[",), (None,), ("[" * 200_000,)], "t string")
    assert [tuple(r) for r in json_schema.infer(broken, **place).collect()] == [("!g", "bad:3", 0, False, False, None, None)]


def test_counters_are_handed_on_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(json_schema, "HELD", 50)
    own = json_schema.Counters()
    own.add(0, {"a": [1, None], "b": {}}, 3)
    assert {("/".join(s), t): n for s, t, n in zip(*(own.batch().column(i).to_pylist() for i in range(3)))} == {("", "object"): 3, (".a", "array"): 3, (".a/[]", "integer"): 3, (".a/[]", "null"): 3, (".b", "object"): 3}


def test_class_model_splits_texts_into_words_twice(spark, monkeypatch):
    """Once to count words and once to code them: all that is learned reads the codes, and they give the keys of the texts."""
    from gridloom.llm import class_lm

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 9)) if i % 5 else None) for i in range(60)], "doc_id long, text string")
    made = []
    real = class_lm.codes
    monkeypatch.setattr(class_lm, "codes", lambda *a: made.append(real(*a)) or made[-1])
    assert class_lm.fit_and_score(docs, ~class_lm.held_out("doc_id"), hot_limit=16, exchange_words=4, classes=3).count() == 60 and len(made) == 1
    hot = class_lm.hot_words(class_lm.word_counts(docs), 16, 4)
    batches = real(docs, hot, (), "text").coalesce(1).toArrow().combine_chunks().to_batches()
    got = [k for b in batches for _, keys in class_lm._coded_tokens(b, hot) for k in keys.tolist()]
    want = [k for (text,) in docs.select("text").collect() for k in class_lm._keys([*(w.encode() for w in (text or "").split()), class_lm.END]).tolist()]
    assert sorted(got) == sorted(want) and class_lm.unit_pairs(real(docs, hot, (), "text"), hot, text_col=None).tolist() == class_lm.unit_pairs(docs, hot).tolist()
