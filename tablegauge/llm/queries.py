"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = (
    "packing_query", "substrings_query", "chat_query", "language_query", "secrets_query", "decontaminate_query", "html_query", "simhash_query",
    "neighbours_query", "lm_query", "phrases_query", "negatives_query", "personal_query",
)


def registered() -> tuple[dict, dict]:
    """All queries by name, and the oracle SQL of those that have one."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tablegauge.llm.{name}")
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLES", {}))
    return queries, oracles
