"""All registered queries: importing this module imports the modules that register them."""

from __future__ import annotations

from tidemark.plans import checks, operations, relational, timeseries, walkforward
from tidemark.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "checks", "operations", "relational", "timeseries", "walkforward"]
