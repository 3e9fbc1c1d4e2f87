"""All queries over the test tables by name, with their SQL."""

from __future__ import annotations

from folioscope.plans import file_queries, more_queries, search_queries, stream_queries
from folioscope.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "file_queries", "more_queries", "search_queries", "stream_queries"]
