"""Registered queries, one for each operator, with the SQL that gives the same result."""

from . import benchmark_queries, derived_queries, document_queries, interval_queries, metric_queries, record_queries, relational_queries, search_queries, study_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
