"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import documents, evaluation, kernel, protocol, reports, retrieval, trust, usage

Query = Callable[[SparkSession, str], DataFrame]
AREAS = (retrieval, documents, kernel, trust, evaluation, protocol, usage, reports)
QUERIES: dict[str, Query] = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for area in AREAS for name, sql in area.ORACLE_SQL.items()}
FLAGSHIP: Query = retrieval.hybrid_page
