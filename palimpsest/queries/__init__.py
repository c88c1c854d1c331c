"""Registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil


def collect() -> tuple[dict, dict]:
    """All queries and all SQL texts of the modules in this package."""
    queries, sql = {}, {}
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        found = importlib.import_module(f"{__name__}.{module}")
        queries |= found.QUERIES
        sql |= found.SQL
    return queries, sql
