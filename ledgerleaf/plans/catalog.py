"""All queries of the catalogue."""

from __future__ import annotations

from . import cells, controls, forms, logs, readings, texts  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
