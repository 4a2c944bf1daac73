"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brownlm, common, fingerprints, html, langid, neardup, packing, secrets, sql, urls, vectors

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), common.tokenizer_file(WORD_BPE))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(common.read_table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(common.read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(common.read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(common.read_table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), common.tokenizer_file(BYTE_BPE), public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(common.crc_fold(F.col("doc_id")) == 0, F.lit(False))
    out = langid.predict(docs, langid.fit(docs.where(~held)))
    return out.select("doc_id", F.coalesce(common.crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brownlm.score(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_secrets, op3_urls, op4_html, op5_near_dedup, op6_vectors, op7_bpe, op8_language, op9_lm, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
