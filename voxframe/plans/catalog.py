"""All registered queries of the transcript engine and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.plans import eval_queries, segment_queries, signal_queries, source_queries, text_queries

_PARTS = (text_queries, segment_queries, eval_queries, signal_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
