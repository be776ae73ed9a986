"""The corpus pipeline: five stages, each applied to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.decontaminate import decontaminate
from siftwell.llm.line_dedup import remove_lines
from siftwell.llm.near_dedup import deduplicate
from siftwell.llm.packing import pack
from siftwell.llm.scratch import Scratch
from siftwell.llm.toxicity import keep_clean

#: No stage but the last changes the columns of documents. SQL expresses neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is fitted on the labelled documents among docs."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of equal or near-equal lines stays; shorter ones than 20 characters must be equal. A document that
    loses its last words goes."""
    left = remove_lines(docs, min_chars=20)
    emptied = (F.col("n_removed") > 0) & (F.regexp_replace("text", r"\s+", "") == "")
    return left.filter(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more, as all stages on word shingles take them (the four words of
    op7_near_dedup are that query's contract)."""
    return deduplicate(docs, n_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages are cut out; documents that consist of them by more than half go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written and read back before the next stage.

    Null and empty texts pass all stages and are packed as their end id. Of rows that repeat a doc_id and its text one stays, unless they have no
    words: such rows all stay. A null doc_id is kept like any other; ties fall to the smallest doc_id. No documents: no rows. Stages keep all columns
    until the last, whose columns are those of the pieces."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
