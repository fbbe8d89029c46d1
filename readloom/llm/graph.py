"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Edges
stay distributed; each round cuts its lineage through the shared folder. A
node with very many links is aggregated with partial sums and joined, never
gathered in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import checkpoint


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b), a > b."""
    around = _both(edges)
    least = around.groupBy("a").agg(F.min("b").alias("mb")).select(F.col("a").alias("u"), F.least("mb", "a").alias("m"))
    large = around.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a > b").distinct()
    least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = large.join(least, F.col("a") == F.col("u"))
    small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
    return small.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; links are (a, b).

    The component is its smallest node. Ends when a round changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = checkpoint(edges)
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        edges = checkpoint(_round(edges))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
