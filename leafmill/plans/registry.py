"""The queries of the driver contract, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import assembly_queries, document_queries, layout_queries, rendering_queries, semantic_queries, text_queries

FLAGSHIP = "page_quality_score"
_MODULES = (text_queries, layout_queries, document_queries, assembly_queries, rendering_queries, semantic_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
