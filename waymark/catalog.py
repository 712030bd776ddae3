"""Registered queries and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("trajectory_queries", "model_queries", "graph_queries", "scoring_queries", "text_queries", "learning_queries")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in _MODULES:
    _m = importlib.import_module(f"waymark.plans.{_name}")
    QUERIES.update(_m.QUERIES)
    ORACLE_SQL.update(_m.ORACLE_SQL)
