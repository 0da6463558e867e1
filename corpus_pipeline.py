"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
session's shared folder and rereads it, so an executor that is lost costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.best_fit_packing import pack_documents
from framesift.llm.common import checkpoint_dir
from framesift.llm.line_dedup import line_dedup
from framesift.llm.quality_fm import keep_good, train
from framesift.llm.secret_crf import redact
from framesift.llm.simhash_dedup import simhash_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.3 or more; it learns from the labels of sf_dir."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(*COLUMNS), train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones, exactly or nearly; n_chars is counted again."""
    n_chars = F.length("text").cast("long").alias("n_chars")
    return line_dedup(docs).select("doc_id", "text", "lang", "source", n_chars)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id.

    Documents without a word after the line stage are one group, as their fingerprint is 0. Rows that
    share the least id all stay, as do those without an id in a group where no row has one.
    """
    kept = simhash_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark; n_chars is counted again."""
    return redact(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: the quality, secret and packing stages have no SQL form; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
