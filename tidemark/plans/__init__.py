"""Registered queries: operators over the adapter views, with their SQL for DuckDB."""

from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "load"]


def load() -> None:
    """Import the modules that register queries."""
    from tidemark.plans import evidence, lookups, places, scene_plans, trips, views, zones  # noqa: F401
