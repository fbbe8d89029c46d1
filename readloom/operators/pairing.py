"""Pairing of reads by name, in the order in which they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.ranking import ranked, running_sum


def pair_by_name(df: DataFrame, name: str = "qname", ordinal: str = "ord", pairs_only: bool = False) -> DataFrame:
    """Adds ``rn``, ``pair_no``, ``single`` and ``close_ord``.

    The second read of a name closes a pair, the third begins a new one.
    ``close_ord`` is the ordinal of the read that closes a pair. Emission order
    is (single, close_ord or name, rn).
    """
    rows = ranked(df, [F.col(ordinal)], [name], "rn")
    pair = ((F.col("rn") - 1) / 2).cast("bigint")
    rows = rows.withColumn("pair_no", pair)
    ends = rows.groupBy(F.col(name).alias("p_name"), F.col("pair_no").alias("p_no")).agg(F.count(F.lit(1)).alias("p_n"), F.max(ordinal).alias("p_close"))
    joined = rows.join(ends, (F.col(name) == F.col("p_name")) & (F.col("pair_no") == F.col("p_no")))
    out = joined.select(*rows.columns, (F.col("p_n") == 1).alias("single"), F.when(F.col("p_n") == 2, F.col("p_close")).alias("close_ord"))
    return out.where(~F.col("single")) if pairs_only else out


def emission_rank(paired: DataFrame, name: str = "qname") -> DataFrame:
    """Adds the place of each read in the grouped output."""
    key = [F.col("single"), F.coalesce("close_ord", F.lit(0)), F.when(F.col("single"), F.col(name)).otherwise(""), F.col("rn")]
    return ranked(paired, key, None, "emit_rank")


def pair_statistics(df: DataFrame, name: str = "qname", ordinal: str = "ord") -> DataFrame:
    """One row: pairs, single reads, and the most names pending when a pair closes."""
    paired = ranked(df.select(name, ordinal), [F.col(ordinal)], [name], "rn")
    closes = F.col("rn") % 2 == 0
    pending = running_sum(paired, [F.col(ordinal)], F.when(closes, -1).otherwise(1), "pending")
    total = pending.agg(F.count_if(closes).alias("pairs"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(closes, F.col("pending") + 1)), F.lit(0)).alias("max_pending"))
    return total.select("pairs", (F.col("n") - 2 * F.col("pairs")).alias("singletons"), "max_pending")
