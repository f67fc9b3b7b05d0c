"""Named queries (one per inventory item) and their oracle SQL."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

_MODULES = [
    "q_scoring",
    "q_tickets",
    "q_reports",
    "q_profile",
    "q_vectors",
    "q_training",
    "q_stream",
]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return {name: sql() if callable(sql) else sql for name, sql in ORACLE.items()}
