"""All queries of the library, gathered from the modules that define them."""

from __future__ import annotations

from siftwell.plans import search_queries, table_queries
from siftwell.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "search_queries", "table_queries"]
