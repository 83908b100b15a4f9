"""Corpus pipeline: stages over the documents table, each written as Parquet before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.llm import bpe, decontam, quality, secrets, shingles
from auditlark.llm.texts import id_remainder
from auditlark.session import scratch

#: A document with a lower quality score goes.
MIN_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents the classifier rejects; labels with crc32(doc_id) mod 5 = 0 stay held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder(F.col("doc_id"), 5) != 0)
    model = quality.fit(labels, docs)
    return quality.score_texts(docs, model, out="_quality").filter(F.col("_quality") >= MIN_QUALITY).drop("_quality")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates: five-word shingles, Jaccard 0.8 or more.

    SimHash fingerprints under covering tables find candidates, min-hashes those beyond their radius.
    """
    return shingles.drop_similar(docs, words=5, similarity=0.8)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by its kind; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and a digest of the text they decode to."""
    vocabulary = bpe.Vocabulary.load(bpe.default_path())
    found = bpe.decode(bpe.encode(docs, vocabulary).drop("text"), vocabulary)
    return found.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("secrets", without_secrets),
    ("tokens", as_tokens),
]

#: The stages have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
