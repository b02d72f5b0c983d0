"""The registered queries."""

from vigilake.plans import relational_queries, report_queries, search_queries, text_queries  # noqa: F401
from vigilake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
