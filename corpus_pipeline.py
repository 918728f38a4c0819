"""Corpus pipeline: raw documents to mixed, tokenised ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Stages share executors, so what one leaves in a Python worker or sends to it at once must not add up: workers keep the
words of one operator at a time (common.remember), and the session sends them texts in batches of BATCH_BYTES.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanaforge.llm import bpe, mixing, quality, simhash, toxicity
from kanaforge.llm.common import documents, labels, packed, table
from kanaforge.llm.queries import BPE_RANKS

#: Bytes of an Arrow batch. At Spark's 64 MB each running task holds that much several times, in its JVM and in its worker.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of about BATCH_BYTES; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _kept(docs: DataFrame, classify: Callable, lab: DataFrame, predicted: int) -> DataFrame:
    """The rows of docs that a classifier predicts so. Each is carried as one struct, so no column of it is replaced."""
    in_small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", packed(docs).alias("row"))
    kept = classify(rows, lab).where(F.col("predicted") == predicted)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return _kept(docs, quality.classify, labels(spark, sf_dir), 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return _kept(docs, toxicity.classify, labels(spark, sf_dir), 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    in_small_batches(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    in_small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores and 64-bit fingerprints are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
