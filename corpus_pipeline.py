"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays (SimHash fingerprints first,
then shingle sets for edited copies that fingerprints hold apart), documents that hold a
benchmark item go, sources are mixed to their weights (a document taken twice stands twice),
and what is left becomes token ids. Every stage works on all rows its predecessor kept and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from semtflow.llm import decontaminate, mixing, near_copies, simhash, token_store, toxicity
from semtflow.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Texts of an Arrow batch: Spark's 10,000 are some 40 MB, held four times a task while they go to Python and back.
#: The bytes bound batches of long rows, such as two shingle sets each.
BATCH_TEXTS, BATCH_BYTES = 1000, 4 << 20


def _bytes(size: str) -> int:
    """A size as Spark writes it, plain or with a unit."""
    digits, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.lower()).groups()
    return int(digits) << 10 * " kmgt".index(unit or " ")


def _batched(stage: Stage) -> Stage:
    """The stage with Arrow batches of whole texts that stay small; smaller settings of the session are kept."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        if not 0 < now <= BATCH_TEXTS:
            spark.conf.set(name, str(BATCH_TEXTS))
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if _bytes(spark.conf.get(name)) > BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@_batched
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_batched
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SimHash operator's groups, one row of each; of what stays, edited copies by exact shares of shingles."""
    return near_copies.drop_near_copies(simhash.drop_near_copies(docs), span=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


@_batched
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.tokenize_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_copies_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]
#: SQL cannot state the language model and the tokenizer; tests/llm/test_pipeline.py follows each stage by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
