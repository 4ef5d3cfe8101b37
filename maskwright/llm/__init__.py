"""Operators for training-data pipelines; queries() and oracle_sql() list them."""

from maskwright.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
