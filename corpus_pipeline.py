"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns that it got, extra ones too (of extra columns named like those that a
stage adds, such as ``n_lines`` or ``mix_block``, the stage's own values stay). Null, empty and very long texts, null
ids, repeated rows and empty tables pass as the operators' docstrings say.

A stage's result names the tables that it is made from; the next stage deletes them when it gets that result read from files, so a stage can be run again
from its own input at any time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, line_dedup, mixing, nb_svm, queries, simhash
from gridloom.llm.columns import by_place, named_again
from gridloom.session import collecting, drop, shared_dir, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Key of the first column's metadata, which Parquet keeps: the tables that a stage's result is made from.
_SCRATCH = "gridloom_scratch"


def _free(spark: SparkSession, docs: DataFrame) -> None:
    """Delete what the stage before it wrote for itself, once ``docs`` is its whole result read from files (not one that is still to be computed)."""
    paths = docs.schema[0].metadata.get(_SCRATCH, []) if docs.columns else []
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        drop(spark, [p for p in paths if p.startswith(f"{shared_dir(spark)}/gridloom/")])


def _stage(stage: Stage) -> Stage:
    """A stage whose result names the tables that it is made from, so that the next stage can free them: no state outside the result, so pipelines can't disturb each other."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _free(spark, docs)
        with collecting() as paths:
            out = stage(spark, docs, sf_dir)
        return out.withMetadata(out.columns[0], {_SCRATCH: paths})

    return run


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores as good."""
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    rows, named = by_place(docs)
    scored = nb_svm.score(rows, model, id_col=named["doc_id"], text_col=named["text"], extra=tuple(c for c in rows.columns if c != named["doc_id"]), out_col="score")
    return named_again(scored.where(F.col("score") >= queries.GOOD), named, docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat across documents."""
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the document of least id, whole.

    Rows are judged one by one: of rows that share the least id of a group one stays, and a row with a text of its own stays whatever
    other rows hold its id. Rows with a null id stay: they can't be named as the one that stays or goes. Groups are those of the
    contract of op7: three words, two differing bits.
    """
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own_id, text = named["doc_id"], named["text"]
    numbered = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.monotonically_increasing_id().alias("row_number"))
    rows = written(simhash.fingerprints(numbered, id_col=own_id, text_col=text, extra=tuple(numbered.columns)), "near-rows")
    found = written(simhash.components(rows.select(own_id, "row_number", "fp"), id_col=own_id).where(F.col(own_id).isNotNull()), "near-components")
    stays = found.where(F.col(own_id) == F.col("component_id")).groupBy("component_id").agg(F.min("row_number").alias("row_number"))
    gone = found.select("row_number").join(stays.select("row_number"), "row_number", "left_anti")
    return rows.join(gone, "row_number", "left_anti").select(*[F.col(n).alias(c) for c, n in named.items()])


#: Where the mixture shows a document: pass, block, and place in the block by ascending order.
LAYOUT = ("mix_pass", "mix_block", "mix_order")


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by flattened weights, laid out block by block: every document at least once, no source more than 1.5 times on average.

    The columns LAYOUT follow those of ``docs``, so that the permutation outlives the files and two showings of a document can be told apart.
    """
    mixed = mixing.mix(docs, max_passes=1.5)
    return mixed.repartition("mix_block").sortWithinPartitions("mix_block", "mix_order").select(*docs.columns, *(c for c in LAYOUT if c not in docs.columns))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and whether decoding them gives the text back; with the LAYOUT that the mixture gave, where there is one."""
    import public_tokenizers

    layout = tuple(c for c in LAYOUT if c in docs.columns)
    ranks = byte_bpe.read_ranks(queries.token_file("byte_bpe_multi_50k.tiktoken"))
    digested = docs.select("doc_id", "lang", "source", *layout, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    encoded = byte_bpe.encode(digested, ranks, public_tokenizers.PATTERN, extra=("lang", "source", *layout, "digest"), decoded_col="decoded")
    whole = F.sha2("decoded", 256) == F.col("digest")
    return encoded.select("doc_id", "lang", "source", *layout, F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", encode),
]
#: A fitted classifier, fingerprints and merges aren't SQL: the stages are tested one by one against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Of the stages' results only the last one's input stays in the shared folder."""
    docs, former = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with collecting() as paths:
            docs = written(made, name.replace(" ", "-"))
        drop(spark, former)  # the input of the stage whose result is complete now
        former = paths
    return STAGES[-1][1](spark, docs, sf_dir)
