"""Composed jobs and the registered queries."""

from __future__ import annotations

import importlib

MODULES = ["graph_queries", "span_queries", "chunk_queries", "desk_queries", "vector_queries", "insight_queries", "retrieval_queries"]


def load():
    """(queries, oracle SQL) of every registered query."""
    from chartloom.plans import registry
    for name in MODULES:
        importlib.import_module(f"chartloom.plans.{name}")
    return registry.QUERIES, registry.ORACLES
