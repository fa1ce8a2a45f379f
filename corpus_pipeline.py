"""From raw documents to packed sequences, one written table per stage.

Language, near duplicates, benchmark passages, personal data, packing. Every stage reads what the stage before
wrote and works on all of it; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ballast.llm.decontamination import drop_contaminated
from ballast.llm.language import drop_unknown_language
from ballast.llm.near_duplicates import drop_near_duplicates
from ballast.llm.packing import pack_documents
from ballast.llm.personal_data import mask_personal_data
from ballast.plans.scratch import materialize, scratch_scope
from ballast.sources.tables import table

#: Most bytes, about, of the rows that go to a Python worker at once, unless the session has its own limit. Executor and worker hold
#: a batch several times over (vector, buffer of the socket, what is made of it), and by Spark's limits it has 10,000 whole texts.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(stage: Callable) -> Callable:
    """``stage`` in a session with this limit. The limit stays, as what a stage returns is computed later."""

    @functools.wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if BATCH not in spark.conf.getAll:
            spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return limited


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts in no language that the labelled rows teach go."""
    return drop_unknown_language(docs)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word shingles and similarity 0.8 the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets; no document goes."""
    return mask_personal_data(docs)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2,048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: No SQL can express the trained network, the tokenizer or the packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), BATCH in spark.conf.getAll
    try:
        for name, stage in STAGES:
            with scratch_scope() as scratch:
                made = stage(spark, docs, sf_dir)
            docs = materialize(made, name)
            scratch.release()
    finally:
        if not own:
            spark.conf.unset(BATCH)
    return docs
