"""Queries over the given tables, by the families they belong to."""

from . import records, usage, web  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
