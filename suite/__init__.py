"""Registered queries over the given tables, and the SQL each must agree with."""

from __future__ import annotations

import importlib

MODULES = ("columns", "findings", "relations", "remedies", "files", "learning")


def registered() -> tuple[dict, dict]:
    """All queries by name, and the oracle SQL of those that have one."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"suite.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
