"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from . import queries_tables  # noqa: F401  registers its queries
from .queries import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
