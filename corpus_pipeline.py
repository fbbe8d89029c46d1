"""A training-corpus pipeline of four stages over ``documents``.

Each stage works on all that its predecessor kept, is written as Parquet and
read again. All but the last return the columns of documents; the last returns
the token ids of what is left.

Defined results: an empty table passes as an empty table; repeated rows stay or
go together, but for near duplicates, where all rows of the smallest id of a
group stay; extra columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, decontaminate, langid, neardup
from readloom.session import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null and empty texts, and those without a letter."""
    labelled = docs.where(langid.crc_mod(F.col("doc_id"), 4) != 2)
    model = langid.train(labelled, tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model).where(F.col("lid_lang") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group: five-word shingles, similarity 0.8. A wordless text is in no group."""
    return neardup.deduplicate(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark; a wordless text holds none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed as little-endian unsigned 32-bit integers), checked by decoding; a null or empty text has none."""
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(docs, path, tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("byte_bpe", tokens)]

#: SQL cannot express the stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
    return out
