"""Training-data pipeline over ``documents``: five stages, each one of the operators of ``evalcube.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows to the shared folder and reads them back as the next one's input.
All but the last return the columns of ``documents`` (further columns pass
through); rows are told apart by their place in the written table, so repeated
and null ids need no care. Stage inputs are file scans.

Defined cases: a null or empty text has no words, so the quality stage drops it;
null languages, sources and ids stay as they are; a text of any length is worked
on as a whole; repeated rows are near duplicates of each other; an empty table
stays empty through all stages; columns that ``documents`` doesn't have, whatever
their names, go along until the last stage and meet no name of a stage's own.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcube.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from evalcube.llm.common import read_documents, stage, with_uid
from evalcube.llm.queries_llm import tokenizer_path


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``n_chars``, where the table has it, brought in line with ``text``."""
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))
    return rows.select(*columns)


#: Columns of ``documents`` that the stages know by name.
KNOWN = ["doc_id", "text", "lang", "source", "n_chars"]


def _set_apart(step):
    """The stage with further columns under names that are no stage's own, and under theirs again afterwards."""

    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        further = {c: f"_further_{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
        out = step(spark, docs.toDF(*(further.get(c, c) for c in docs.columns)), sf_dir)
        back = {v: k for k, v in further.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns))
    return run_stage


@_set_apart
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept = quality_rules.judge(docs).filter("kept").select("uid")
    return with_uid(docs).join(kept, "uid", "left_semi").drop("uid")


@_set_apart
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (at least 80 % of their five-word shingles in common)."""
    first = stage(ngram_join.near_duplicate_groups(docs, width=5, percent=80).filter("first").select("uid"), "pipeline-first")
    return with_uid(docs).join(first, "uid", "left_semi").drop("uid")


@_set_apart
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes, that occur again; those left without a word by it go."""
    columns = docs.columns
    out = suffix_dedup.remove_repeats(docs, words=51)
    cut = stage(out.filter("n_removed > 0").select("uid", F.col("kept_text").alias("_kept")), "pipeline-cut")
    rows = with_uid(docs).join(cut, "uid", "left")
    gone = F.col("_kept").isNotNull() & ~F.coalesce(F.col("_kept").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _with_text(rows.filter(~gone).withColumn("text", F.coalesce("_kept", "text")), columns)


@_set_apart
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, with the words that the pass takes."""
    columns = docs.columns
    _, slices = mixing.mix(docs)
    return _with_text(mixing.mixed_documents(docs, slices), columns)


@_set_apart
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 4,096."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Byte spans, pseudorandom permutations and token ids are beyond SQL; tests hold the near-duplicate and passage stages against planted texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
