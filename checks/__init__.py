"""Queries over the given tables, each with the SQL that must give the same rows."""

from . import cleaning, gold, governance, learning, metrics, panels, profiling, sources
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "gold", "governance", "learning", "metrics", "panels", "profiling",
           "sources"]
