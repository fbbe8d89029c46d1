"""Sharding by jump consistent hashing, in DataFrame functions only.

Jump consistent hashing (Lamping and Veach, 2014) walks from bucket to bucket
with a linear congruential generator seeded by the key; the last bucket below
the number of shards is the key's shard. No table of shards is needed, and a
shard appended at the end takes 1/(n+1) of the rows and moves no others.

Law: ``key``. The row's id and the number of shards alone decide.

Defined results: a null id is a key of its own (as the text ``~``); a null
text has no bytes (size is the overhead alone, checksum 0); rows with the same
id share a shard and get slots of their own; an empty table gives no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
OVERHEAD = 16
_M32 = 0xFFFFFFFF
_M16 = 0xFFFF


def stable_key(col: Column) -> Column:
    """60 bits of the MD5 of the id as text: the same on every engine."""
    text = F.coalesce(col.cast("string"), F.lit("~"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, in parts that cannot overflow."""
    low_c, high_c = MULTIPLIER & _M32, MULTIPLIER >> 32
    lo = key.bitwiseAND(F.lit(_M32))
    hi = F.shiftrightunsigned(key, 32)
    p0 = lo.bitwiseAND(F.lit(_M16)) * F.lit(low_c)
    p1 = F.shiftright(lo, 16) * F.lit(low_c)
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(_M16)), 16) + F.lit(1)
    h0 = hi.bitwiseAND(F.lit(_M16)) * F.lit(low_c)
    h1 = F.shiftleft((F.shiftright(hi, 16) * F.lit(low_c)).bitwiseAND(F.lit(_M16)), 16)
    high = (
        F.shiftright(low, 32)
        + F.shiftright(p1, 16)
        + (lo * F.lit(high_c)).bitwiseAND(F.lit(_M32))
        + h0.bitwiseAND(F.lit(_M32))
        + h1
    )
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_M32)))


def jump_hash(key: Column, n_shards: int) -> Column:
    """The shard of a 64-bit key, 0 to n_shards - 1.

    The walk moves forward by one bucket or more, so n_shards steps always end
    it; a step after the end changes nothing.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    n = F.lit(float(n_shards))

    def step(s: Column, _: Column) -> Column:
        key2 = _next_key(s["k"])
        b = s["j"]
        j = F.floor((b + 1.0) * (F.lit(2147483648.0) / (F.shiftrightunsigned(key2, 33) + 1).cast("double")))
        moved = F.struct(key2.alias("k"), b.alias("b"), F.least(j.cast("double"), F.lit(4e15)).alias("j"))
        return F.when(s["j"] >= n, s).otherwise(moved)

    start = F.struct(key.alias("k"), F.lit(-1.0).alias("b"), F.lit(0.0).alias("j"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(n_shards + 1)), start, step, lambda s: s["b"])
    return walk.cast("int")


def shard(
    df: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_buckets: int = 64,
) -> DataFrame:
    """One row per input row with its shard, slot and shard after one is added.

    Slots count from 0 without gaps within a shard. No task sorts a whole
    shard: rows of a shard are split by hash over ``slot_buckets`` buckets that
    are numbered apart, and each bucket starts where the ones before it end.
    The table of starts has (n_shards * slot_buckets) rows at most, which
    bounds what is broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        stable_key(F.col(id_col)).alias("k"),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        jump_hash(F.col("k"), n_shards).alias("shard"),
        jump_hash(F.col("k"), n_shards + 1).alias("grown_shard"),
        F.pmod(F.col("k") + F.col("text_crc32"), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(
        F.col("shard").alias("s_shard"),
        F.col("bucket").alias("s_bucket"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start"),
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("r", F.row_number().over(within).cast("bigint") - 1)
    return numbered.join(
        F.broadcast(starts),
        (F.col("shard") == F.col("s_shard")) & (F.col("bucket") == F.col("s_bucket")),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("r") + F.col("start")).alias("slot"),
        "grown_shard",
    )
