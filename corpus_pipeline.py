"""The corpus pipeline: stages from documents to token files.

Each stage takes the documents that the one before it kept, and all but the last return the columns of
documents. Stages are written and read again in between, so a lost executor repeats one stage at most. Stages
set the size of the session's Arrow batches, as whole texts go to Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, mixing, neardup, ranking, tokens
from tidewatch.llm.common import small_batches, table
from tidewatch.llm.queries import tokenizer_path
from tidewatch.session import staged


#: Words that a worker remembers for token files: fewer than usual, as its memory has served the stages before.
REMEMBERED = 150_000


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    small_batches(spark)
    return ranking.accepted(docs, table(spark, folder, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixing.mixed(docs, mixing.n_words(F.col("text")), F.array(F.col("source").cast("string")))


def token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids in flat files, and per document what they hold."""
    small_batches(spark)
    return tokens.tokens_of(docs, tokenizer_path(), remembered=REMEMBERED)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_files", token_files),
]

#: Learned scores, hashed bands and the tokenizer have no SQL; tests/llm/test_pipeline.py follows the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, folder, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
