"""A corpus pipeline: five stages, each one operator applied to what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corundum.llm import bpe, exact_dedup, mixing, simhash, toxicity
from corundum.llm.common import shared_folder, table
from corundum.tables import Files


#: Rows that executors hand to Python workers at once: JVM and worker each hold a whole batch of texts, and Spark's 10,000
#: rows of them took tens of MB on either side of every task.
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage with Arrow batches of at most ``ARROW_ROWS`` rows.  Stages are lazy, so the session keeps that setting."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(ARROW)) <= ARROW_ROWS:
            spark.conf.set(ARROW, str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.screen(docs, table(spark, sf_dir, "labels"))


@small_batches
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_winners(docs)


@small_batches
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


@small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix_rows(docs)


@small_batches
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, one row a copy."""
    return bpe.tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encode_stage),
]

#: Learnt scores and a tokenizer's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage read goes once it is done, the last table with the process."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    files = Files(spark, folder)
    atexit.register(_forget, files)
    held = spark.conf.get(ARROW)
    try:
        for i, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                files.delete(f"{i - 1}-{STAGES[i - 1][0]}")
    finally:
        spark.conf.set(ARROW, held)
    return docs


def _forget(files: Files) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        files.remove()
