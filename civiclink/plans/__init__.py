"""Queries over the given tables, one module per family."""

from civiclink.plans import graph, landed_pages, linking, outcomes, places, provenance, storage, text_functions  # noqa: F401
from civiclink.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
