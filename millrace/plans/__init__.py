"""The registered queries of the library."""

from . import job_queries, review_queries, score_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "job_queries", "review_queries", "score_queries", "text_queries"]
