"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from catalog import features, images, scores, tables, text  # noqa: F401  (fill the registry)
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
