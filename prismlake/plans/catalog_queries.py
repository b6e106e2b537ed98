"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import queries_groups, queries_read, queries_scalar, queries_store  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "duplicates"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
