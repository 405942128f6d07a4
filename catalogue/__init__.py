"""Registered queries over the driver's tables, each with its DuckDB twin where SQL can say it."""

from catalogue import (  # noqa: F401
    aggregates,
    composites,
    ingestion,
    joins,
    listings,
    models,
    text_functions,
    trend_views,
)
from catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
