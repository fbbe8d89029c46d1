"""Ranks, running sums and order checks without a single-task window.

Rows are range-partitioned by the full key, so that even a group that holds a
third of all rows is cut over many tasks. Each task numbers its own rows; what
lies before a task comes from a table with a row for each task, or two for each
task if there are groups, and this bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import checkpoint

_PART = "rl_part"


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Range-partitioned and cut off, since sampled bounds must not change."""
    return checkpoint(df.repartitionByRange(*keys).withColumn(_PART, F.spark_partition_id()))


def ranked(df: DataFrame, order: list[Column], groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds row numbers from 1 (bigint), over all rows or within groups."""
    groups = groups or []
    rows = _ranged(df, [*map(F.col, groups), *order])
    within = Window.partitionBy(_PART, *groups).orderBy(*order)
    rows = rows.withColumn(name, F.row_number().over(within).cast("bigint"))
    before = Window.partitionBy(*groups).orderBy("rl_p").rowsBetween(Window.unboundedPreceding, -1)
    if not groups:
        starts = rows.groupBy(F.col(_PART).alias("rl_p")).agg(F.count(F.lit(1)).alias("rl_n"))
        starts = starts.select("rl_p", F.coalesce(F.sum("rl_n").over(before), F.lit(0)).alias("rl_before"))
        match = F.col(_PART) == F.col("rl_p")
    else:
        # Only the first and the last group of a task can go on in another task.
        key = F.struct(*groups)
        ends = rows.groupBy(_PART).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        ends = ends.select(F.explode(F.array("lo", "hi")).alias("g")).distinct()
        ends = ends.select(*[F.col("g")[g].alias(f"rl_g{i}") for i, g in enumerate(groups)])
        same = [F.col(g).eqNullSafe(F.col(f"rl_g{i}")) for i, g in enumerate(groups)]
        cut = rows.join(F.broadcast(ends), _all(same)).groupBy(F.col(_PART).alias("rl_p"), *[f"rl_g{i}" for i in range(len(groups))])
        cut = cut.agg(F.count(F.lit(1)).alias("rl_n"))
        before = Window.partitionBy(*[f"rl_g{i}" for i in range(len(groups))]).orderBy("rl_p").rowsBetween(Window.unboundedPreceding, -1)
        starts = cut.withColumn("rl_before", F.coalesce(F.sum("rl_n").over(before), F.lit(0)))
        match = _all([F.col(_PART) == F.col("rl_p"), *same])
    out = rows.join(F.broadcast(starts), match, "left").withColumn(name, F.col(name) + F.coalesce("rl_before", F.lit(0)))
    return out.select(*df.columns, name)


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with this one."""
    rows = _ranged(df.withColumn("rl_v", value), order)
    own = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.groupBy(F.col(_PART).alias("rl_p")).agg(F.sum("rl_v").alias("rl_n"))
    before = Window.orderBy("rl_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("rl_p", F.coalesce(F.sum("rl_n").over(before), F.lit(0)).alias("rl_before"))
    out = rows.withColumn(name, F.sum("rl_v").over(own)).join(F.broadcast(starts), F.col(_PART) == F.col("rl_p"))
    return out.withColumn(name, (F.col(name) + F.col("rl_before")).cast("bigint")).select(*df.columns, name)


def inversions(df: DataFrame, order: list[Column], key: Column) -> DataFrame:
    """One row: how many rows have a smaller key than the row before them."""
    rows = _ranged(df.select(*[c.alias(f"rl_o{i}") for i, c in enumerate(order)], key.alias("rl_k")), [F.col(f"rl_o{i}") for i in range(len(order))])
    own = Window.partitionBy(_PART).orderBy(*[f"rl_o{i}" for i in range(len(order))])
    inner = rows.withColumn("rl_prev", F.lag("rl_k").over(own)).agg(F.count_if(F.col("rl_k") < F.col("rl_prev")).alias("n"), F.count(F.lit(1)).alias("rows"))
    at = F.struct(*[f"rl_o{i}" for i in range(len(order))])
    edges = rows.groupBy(_PART).agg(F.min_by("rl_k", at).alias("first"), F.max_by("rl_k", at).alias("last"))
    across = edges.withColumn("prev", F.lag("last").over(Window.orderBy(_PART))).agg(F.count_if(F.col("first") < F.col("prev")).alias("m"))
    return inner.crossJoin(across).select(F.col("rows").alias("n_rows"), (F.col("n") + F.col("m")).alias("n_inversions"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
