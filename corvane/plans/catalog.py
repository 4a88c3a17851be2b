"""All queries over the driver's tables with their SQL, by name."""

from . import corpus_queries, edge_queries, log_queries, vector_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
