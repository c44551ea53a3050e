"""Registered queries and the SQL each one is checked against."""

from lakesync.queries.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
