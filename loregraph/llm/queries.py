"""The pN_ queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: One module of queries per problem; each has QUERIES and ORACLES.
MODULES = ("q_secrets", "q_names", "q_language", "q_pairs", "q_packing", "q_leaks", "q_subjects")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"loregraph.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
