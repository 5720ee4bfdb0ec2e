"""Named queries of the engine and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovelens.plans import eval_queries, index_queries, kept_queries, lifecycle_queries, search_queries, stream_queries

FLAGSHIP = "hybrid_search"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search_queries.QUERIES, **eval_queries.QUERIES, **index_queries.QUERIES, **lifecycle_queries.QUERIES, **kept_queries.QUERIES, **stream_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**search_queries.ORACLE_SQL, **eval_queries.ORACLE_SQL, **index_queries.ORACLE_SQL, **lifecycle_queries.ORACLE_SQL, **kept_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL}
