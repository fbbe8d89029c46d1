"""Joins on overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import bins_overlapping
from readloom.functions.intervals import overlaps


def overlap_join(left: DataFrame, right: DataFrame, name: str = "name", bucket: int = 1 << 17, widest: int = 64) -> DataFrame:
    """Pairs of rows on one sequence whose intervals overlap.

    Both sides have (name, zstart, zlimit); the right side's columns come out
    with the prefix ``r_``. Intervals are dealt to buckets of a fixed width, so
    that a sequence with most of the rows is spread over many tasks; a pair
    counts in the bucket where the later of the two begins. Intervals over more
    than ``widest`` buckets would be repeated too often: they are dealt by wider
    buckets, the width of each level being ``widest`` times the one below. Each
    side is dealt for each level that the other may have, at the wider of the two
    widths, and both levels are part of the key: so narrow intervals meet only
    in narrow buckets, and no interval has more than ``widest`` + 1 rows for each
    level of the other side.
    """
    right = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    levels = [bucket]
    while levels[-1] * widest < 1 << 31:
        levels.append(levels[-1] * widest)

    def dealt(df: DataFrame, start: str, limit: str, own: str, other: str) -> DataFrame:
        size = F.col(limit) - F.col(start)
        level = F.lit(len(levels) - 1)
        for i in range(len(levels) - 2, -1, -1):
            level = F.when(size <= levels[i] * widest, i).otherwise(level)
        rows = df.withColumn(f"level_{own}", level).withColumn(f"level_{other}", F.explode(F.array(*map(F.lit, range(len(levels))))))
        width = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in levels]), F.greatest("level_a", "level_b") + 1)
        last = F.greatest(F.col(start), F.col(limit) - 1)
        return rows.withColumn("width", width).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / F.col("width")), F.floor(last / F.col("width")))))

    a = dealt(left, "zstart", "zlimit", "a", "b")
    keys = ["level_a", "level_b", "bucket"]
    b = dealt(right, "r_zstart", "r_zlimit", "b", "a").drop("width").withColumnsRenamed({k: f"r_{k}" for k in keys})
    meets = F.col(name) == F.col(f"r_{name}")
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"r_{k}"))
    once = F.col("bucket") == F.floor(F.greatest("zstart", "r_zstart") / F.col("width"))
    both = a.join(b, meets & once & overlaps(F.col("zstart"), F.col("zlimit"), F.col("r_zstart"), F.col("r_zlimit")))
    return both.select(*left.columns, *right.columns)


def overlap_join_plain(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """The same by a join on the sequence alone; for few rows on each sequence."""
    right = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    hit = overlaps(F.col("zstart"), F.col("zlimit"), F.col("r_zstart"), F.col("r_zlimit"))
    return left.join(right, (F.col(name) == F.col(f"r_{name}")) & hit)


def read_intervals(df: DataFrame, span: str = "span", name: str = "rindex") -> DataFrame:
    """The rows with their intervals: zstart, zlimit on their reference; reads without one are left out."""
    out = df.withColumn("zstart", F.col("zpos").cast("bigint")).withColumn("zlimit", F.col("zpos") + F.col(span))
    return out.where(F.col(name) >= 0 if name == "rindex" else F.col(name) != "*")


def region(df: DataFrame, index: int, zstart: int, zlimit: int, span: str = "span", bin_column: str = "bin") -> DataFrame:
    """Reads that overlap a region; ranges of bins go first, as plain comparisons."""
    in_bins = F.lit(False)
    for low, high in bins_overlapping(zstart, zlimit):
        in_bins = in_bins | F.col(bin_column).between(low, high)
    hit = overlaps(F.col("zpos"), F.col("zpos") + F.col(span), F.lit(zstart), F.lit(zlimit))
    return df.where((F.col("rindex") == index) & in_bins & hit)
