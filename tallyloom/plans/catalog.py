"""All queries by name, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from tallyloom.plans import detail_queries, document_queries, fact_queries, integrity_queries, list_queries, queue_queries, report_queries, staging_queries, stream_queries
from tallyloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "detail_queries", "document_queries", "fact_queries", "integrity_queries", "list_queries", "queue_queries", "report_queries", "staging_queries", "stream_queries"]
