"""A corpus pipeline: documents through five stages, each of which works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage's result is to be written as Parquet and read again as the next one's docs; run()
does so in the shared folder, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import bpe, decontam, quality, secrets, simhash
from wavemill.llm.common import read_table, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by the benchmark."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, n_tokens, ids, and the digests of ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_digests=True, with_decoded=False, remembered=50_000)  # words a generation: some 25 MB a worker


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
#: A trained classifier and XXH64 are out of DuckDB's reach; tests hold each stage against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
