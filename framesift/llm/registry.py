"""Queries and SQL of this subpackage, for __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.order_minhash import as_text, order_minhash

    return order_minhash(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text("signature").alias("fingerprint"),
        as_text("edited_signature").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.simhash_dedup import simhash_components

    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.quality_fm import score_texts, train

    docs = documents(spark, sf_dir)
    return score_texts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op8_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.secret_crf import scan_secrets

    found = scan_secrets(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "field")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size("tagged").cast("long").alias("n_tagged"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.best_fit_packing import pack_documents

    return pack_documents(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framesift.llm.byte_bpe import digest_texts

    return digest_texts(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


SQL = {
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS body,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), o AS (
            SELECT doc_id, norm, length(body) AS n,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM o
    """,
}


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for k, v in SQL.items()}
