"""All registered queries over the reference's kind of tables."""

from albumen.plans import people_queries, photo_queries, search_queries, status_queries  # noqa: F401
from albumen.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
