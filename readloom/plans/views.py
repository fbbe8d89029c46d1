"""Alignment-shaped views over the order tables, as SQL for Spark and DuckDB."""

from __future__ import annotations

ALN = """
SELECT o_orderkey AS ord, 'r' || CAST((o_orderkey*7919)%1009 AS string) AS qname,
  CAST((o_orderkey*2654435 + o_custkey)%4096 AS int) AS flag,
  CAST(CASE WHEN o_custkey%11=0 THEN -1 ELSE o_custkey%25 END AS int) AS rindex,
  CAST(CASE WHEN o_custkey%11=0 THEN -1 ELSE (o_orderkey*104729 + o_custkey*7)%250000000 END AS bigint) AS zpos,
  CAST(o_orderkey%61 AS int) AS mapq,
  CASE o_orderkey%8 WHEN 0 THEN '*' WHEN 1 THEN '100M' WHEN 2 THEN '5S90M5S' WHEN 3 THEN '50M2I48M' WHEN 4 THEN '40M10D60M'
    WHEN 5 THEN '30M5000N70M' WHEN 6 THEN '10H50=1X49=' ELSE '3S20M1P5I70M2H' END AS cigar,
  CASE o_orderkey%8 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 90 WHEN 3 THEN 98 WHEN 4 THEN 110 WHEN 5 THEN 5100
    WHEN 6 THEN 100 ELSE 90 END AS ref_len,
  CASE WHEN o_orderkey%13=0 THEN NULL ELSE o_orderpriority END AS rg
FROM {orders}"""

RGH = """
SELECT * FROM (VALUES ('1-URGENT','libA'),('2-HIGH','libA'),('3-MEDIUM','libB'),('4-NOT SPECIFIED',''),('6-EMPTY','libC')) AS t(id,lb)"""

FEAT = """
SELECT p_partkey AS feat_id, CAST(p_partkey%25 AS int) AS rindex, CAST((p_partkey*102947)%250000000 AS bigint) AS zstart,
  CAST((p_partkey*102947)%250000000 + CASE WHEN p_partkey%7=0 THEN 0 ELSE p_size*1000 END AS bigint) AS zlimit FROM {part}"""

SP = "SELECT *, CAST(CASE WHEN (flag&4)<>0 THEN 1 ELSE greatest(1,ref_len) END AS bigint) AS span FROM aln"


def spark_view(spark, sf_dir: str, text: str):
    return spark.sql(text.format(orders=f"parquet.`{sf_dir}/orders.parquet`", part=f"parquet.`{sf_dir}/part.parquet`"))


def oracle(select: str) -> str:
    """A DuckDB query over the same views."""
    aln, feat = ALN.format(orders="orders"), FEAT.format(part="part")
    return f"WITH aln AS ({aln}),\nrgh AS ({RGH}),\nfeat AS ({feat}),\nsp AS ({SP})\n{select}"
