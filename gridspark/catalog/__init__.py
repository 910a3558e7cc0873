"""The registered queries, one per operator, with the SQL that states the expected result."""

from __future__ import annotations

import importlib

MODULES = ("q_sources", "q_reshape", "q_select", "q_align", "q_scores", "q_fields", "q_resample", "q_scalar",
           "q_samples", "q_rotated")


def load_queries():
    """All queries by name."""
    for module in MODULES:
        importlib.import_module(f"gridspark.catalog.{module}")
    from gridspark.catalog.registry import QUERIES

    return QUERIES
