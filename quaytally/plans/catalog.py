"""All queries by name: each reads the given tables of a folder and returns a DataFrame."""

from __future__ import annotations

from quaytally.plans import extra_queries, order_queries, page_queries, parse_queries, parser_queries, report_queries, rule_queries, snapshot_queries, stream_queries  # noqa: F401  each registers its queries
from quaytally.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
