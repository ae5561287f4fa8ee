"""All queries over the planner, storage, converters and text operators."""

from __future__ import annotations

from epochweave import convert_queries, plan_queries, storage_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from epochweave.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
