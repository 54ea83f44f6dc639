"""The library's queries over the tables at hand."""

from wordloom.plans import file_queries, interval_queries, text_queries, timing_queries
from wordloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "file_queries", "interval_queries", "text_queries", "timing_queries"]
