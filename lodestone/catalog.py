"""All queries on the reference's operators, with their DuckDB equivalents."""

from __future__ import annotations

from .plans import market, sources, streams, text  # noqa: F401  they register their queries
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
