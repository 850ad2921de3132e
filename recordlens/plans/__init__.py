"""Queries over the driver's tables, each with its DuckDB SQL where SQL can state it."""

from .base import REGISTRY, Tables, query
from . import capture, joined, minutes, pages, records, reviews, rollups, text, threads  # noqa: F401  (they register their queries)

__all__ = ["REGISTRY", "Tables", "query"]
