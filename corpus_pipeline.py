"""A training corpus out of raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every stage's
result as Parquet to the shared folder that the session names and reads it again for the next,
so a lost executor costs one stage's tasks at most. All stages but the last return the columns
of documents.

Nulls and odd rows: a document with a null or letterless text has no language and goes in the
first stage; a null id can't be grouped, so such a row stays in the second; null texts match
no benchmark item and hold no secret; a repeated id keeps one row from the second stage on.
Columns beyond those of documents are carried along unchanged. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from cohortstats.llm import common, decontaminate, langid, packing, secrets, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the model rejects go."""
    common.small_batches(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that fingerprints link."""
    common.small_batches(spark)
    return simhash.near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; credentials that look live are replaced in their texts."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    common.small_batches(spark)
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Fingerprints, character models and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; the last one's result, read back."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    out = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        out = spark.read.parquet(f"{folder}/{k}-{name}")
    return out
