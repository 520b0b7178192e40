from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, queries
from gridloom.session import table, written

from .test_text_operators import brute_components, brute_lines, brute_simhash


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    (_, classify), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = written(classify(spark, docs, sf_dir), "t1")
    scores = {r.doc_id: r.score for r in queries.op1_nb_svm(spark, sf_dir).collect()}
    assert good.columns == docs.columns
    assert Counter(map(tuple, good.collect())) == Counter(tuple(r) for r in docs.collect() if scores[r.doc_id] >= 0.7)
    clean = written(lines(spark, good, sf_dir), "t2")
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t, _, _ in brute_lines([(r.doc_id, r.text) for r in good.collect()]).elements())
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    kept = written(near(spark, clean, sf_dir), "t3")
    prints = {r.doc_id: brute_simhash(r.text) for r in clean.collect()}
    group, least = brute_components(set(prints.values())), {}
    for i, f in prints.items():
        least[group[f]] = min(least.get(group[f], i), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    mixed = written(mix(spark, kept, sf_dir), "t4")
    assert mixed.columns == [*docs.columns, *corpus_pipeline.LAYOUT]
    shown = mixed.collect()
    assert Counter(map(tuple, mixed.where("mix_pass = 0").select(*docs.columns).collect())) == Counter(map(tuple, kept.select(*docs.columns).collect()))  # each once, whole
    places = [(r.doc_id, r.mix_pass) for r in shown]
    assert len(set(places)) == len(places) and all((i, k - 1) in set(places) for i, k in places if k)
    wanted = mixing.mix(kept, max_passes=1.5).select("doc_id", *corpus_pipeline.LAYOUT).collect()
    assert Counter(map(tuple, wanted)) == Counter((r.doc_id, r.mix_pass, r.mix_block, r.mix_order) for r in shown)
    final = encode(spark, mixed, sf_dir).collect()
    assert Counter((r.doc_id, r.mix_pass, r.mix_block, r.mix_order) for r in final) == Counter(map(tuple, wanted))
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in final)


def test_run(spark, sf_dir):
    assert set(corpus_pipeline.run(spark, sf_dir).columns) == {"doc_id", "lang", "source", *corpus_pipeline.LAYOUT, "n_tokens", "ids", "decodes"}


def test_near_duplicates_by_row(spark, sf_dir):
    same, other = "a text of several words that two rows share", "quite another text with words of its own"
    docs = spark.createDataFrame([(1, same), (2, same), (2, other), (5, "one more text that stands alone here"), (5, "one more text that stands alone here"), (None, same), (None, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == Counter([(1, same), (2, other), (5, "one more text that stands alone here"), (None, same), (None, None)])


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string, n_lines string, mix_block string, ids string, tokens string, fp string"
    rows = [(1, None, None, None, None), (None, "no id at all", "en", "s", 3), (2, "", "en", None, 0), (3, "some words " * 20_000, "en", "s", 1), (4, "twice the same text here", "en", "t", 2), (4, "twice the same text here", "en", "t", 2)]
    for own in (rows, []):
        docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in own], schema)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = written(stage(spark, docs, sf_dir), "odd")
            gone = {2} if name == "SimHash near-dedup" else set()  # as empty as the first
            added = [c for c in corpus_pipeline.LAYOUT if name == "mixing" and c not in docs.columns]
            assert out.columns == [*docs.columns, *added] and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - gone
        kept = written(corpus_pipeline.classify(spark, docs, sf_dir), "odd")
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {r.doc_id for r in docs.collect()}
        assert corpus_pipeline.encode(spark, docs, sf_dir).count() == len(own)


def test_stages_keep_columns_named_like_their_own(spark, sf_dir):
    own = ["score", "__score", "__gone", "__row", "__source", "__drawn", "__order", "__part", "__offset", "__start", "__budget", "__total", "__tokens", "mix_tokens", "row_number", "fp", "c0", "c1", "digest", "stays", "component_id", "places"]
    docs = table(spark, sf_dir, "documents").withColumns({c: F.concat(F.lit("kept "), F.col("doc_id")) for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "clash")
        rows = docs.select("doc_id", *[c for c in own if c != "mix_tokens" or name != "mixing"]).collect()
        assert rows and all(v == f"kept {r.doc_id}" for r in rows for v in r[1:]), name
    encoded = corpus_pipeline.encode(spark, docs, sf_dir)
    assert encoded.count() == docs.count()


def test_a_stage_frees_what_the_one_before_left_once_its_result_is_read_from_files(spark, sf_dir):
    def there(paths):
        return [spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths]

    docs = table(spark, sf_dir, "documents")
    made = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    left = made.schema[0].metadata["gridloom_scratch"]
    assert left and all(there(left))
    corpus_pipeline.mix(spark, made, sf_dir)  # not written yet: nothing goes
    assert all(there(left))
    again = corpus_pipeline.near_duplicates(spark, docs, sf_dir)  # a second pipeline doesn't disturb the first
    assert all(there(left)) and made.count() == again.count()
    corpus_pipeline.mix(spark, written(made, "result"), sf_dir)
    assert not any(there(left)) and all(there(again.schema[0].metadata["gridloom_scratch"]))
