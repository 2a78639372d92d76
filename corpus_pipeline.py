"""Corpus pipeline: language, quality, near copies, repeated passages, packing.

``STAGES`` names the steps in order; each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``docs``; the last one
returns the packed pieces.

1. ``language`` trains the language model on the labelled rows of ``docs`` that
   are not held out and drops the documents that it rejects (no letters, or a
   confidence under the calibrated threshold).
2. ``quality`` drops the documents that the current policy of the rule ledger
   does not keep.
3. ``near_copies`` keeps one document of each component of the Jaccard join.
4. ``repeated_passages`` cuts out the bytes of 200-byte strings that start
   elsewhere too; a document of which only white space is left goes.
5. ``packing`` tokenises and packs what is left.

Training samples rows by the hash of their id, so the result does not depend
on partitioning; no SQL expresses stages 1, 3 to 5, so the tests hold the
pipeline against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadic.llm import jaccard, langid, packing, quality, substrings
from dyadic.llm.common import stored, table
from dyadic.session import ensure_checkpoint_dir


BATCH_ROWS = 2000  # texts to an Arrow batch: bounds what a worker holds at once


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return langid.keep_known(docs, langid.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return substrings.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return packing.packed_sequences(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", best_fit_packing),
]

# language, near copies, repeated passages and packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
