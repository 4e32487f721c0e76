"""Queries by name and their DuckDB SQL."""

from .plans import cleaning, index, ingest, matching, models, relational, robustness, validation  # noqa: F401
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
