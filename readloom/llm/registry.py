"""Registered queries of this subpackage: name -> function(spark, sf_dir)."""

from __future__ import annotations

from readloom.llm import oracles, queries

QUERIES = dict(queries.QUERIES)
ORACLES = dict(oracles.ORACLES)
