"""Registered queries over the given tables, each with its check SQL."""

from catalog import aggregates, cleaning, flows, joins, lookups, model, quality, sources, windows  # noqa: F401
from catalog.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
