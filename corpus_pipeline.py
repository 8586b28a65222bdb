"""A corpus from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webjourney.llm import bestfit, line_dedup, ngram_join, quality, secret_scan
from webjourney.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in ten or more sources; ``n_chars`` follows where a text has changed."""
    cleaned = line_dedup.clean(docs, min_sites=10)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, then digest; null ids come last.

    Rows are compared each by itself, also those that share an id or have none. Texts without words stay.
    """
    keyed = stored(docs.withColumn("__key", F.monotonically_increasing_id()))
    groups = ngram_join.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("__key"), "group_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.col("text").cast("binary")), "__key")
    first = keyed.select("__key", order.alias("order")).join(groups, "__key").groupBy("group_id").agg(
        F.min("order").getField("__key").alias("__key")).select("__key")
    return keyed.join(first, "__key", "left_semi").select(docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark; ``n_chars`` follows."""
    masked = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        marked = F.col("text").contains("[SECRET]")
        masked = masked.withColumn("n_chars", F.when(marked, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1,024 tokens."""
    pieces = bestfit.encode_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return bestfit.assign(digests, capacity=1024).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_removal),
    ("n-gram join", near_duplicates),
    ("secret scan", secrets_out),
    ("packing", packing),
]

#: The forest cannot be written in SQL; the README says what the tests hold the stages against.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
