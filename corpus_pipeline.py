"""A corpus pipeline: language ID, near-duplicate removal, secret redaction and packing, each over the rows kept before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, langid, neardup, packing, secrets

WORD_BPE = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects; it learns from the stage's own labelled rows."""
    common.small_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    common.small_batches(spark)
    return neardup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    common.small_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences."""
    common.small_batches(spark)
    return packing.pack(docs, common.tokenizer_file(WORD_BPE))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("redact_secrets", redact_secrets), ("pack", pack)]
#: The language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine = common.scratch_count()
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        common.clear_scratch(spark, since=mine, keep=1)  # a stage's own tables aren't needed beyond it
    return STAGES[-1][1](spark, docs, sf_dir)
