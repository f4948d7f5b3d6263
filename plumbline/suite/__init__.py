"""The library's checks and reports as named queries over the test tables."""

from plumbline.suite.registry import QUERIES, oracle_sql, queries

__all__ = ["QUERIES", "oracle_sql", "queries"]
