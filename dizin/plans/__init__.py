"""Queries that bind the operators to the driver's tables."""

from dizin.plans import browse_queries, extract_queries, match_queries, source_queries, text_queries, timetable_queries, upsert_queries  # noqa: F401
from dizin.plans.registry import QUERIES, SQL  # noqa: F401
