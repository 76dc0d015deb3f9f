"""Queries over the given tables, one for each operator."""

import importlib

from ..registry import QUERIES, SQL

MODULES = ("q_windows", "q_joins", "q_aggregates", "q_cross", "q_stats", "q_quality", "q_folds", "q_more")


def load():
    """All queries and their SQL."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, SQL
