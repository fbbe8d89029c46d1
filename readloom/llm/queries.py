"""The ``opN`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, decontaminate, html, langid, lm, neardup, sharding, topk, urls, warc

QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out), tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score")
    )


@_query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort(F.transform("bd_items", lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id",
        F.col("bd_n_words").alias("n_words"),
        F.col("bd_n_hit").alias("n_hit"),
        F.size("bd_items").cast("bigint").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("bd_n_hit") > 0).alias("contaminated"),
    )


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of the query's contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@_query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    judged = urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, tokenizers.path("word_bpe_49k.json"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score", "tokens")


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.group(_table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


@_query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return lm.score(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
