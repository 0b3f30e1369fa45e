"""The engine's queries by subject; collected here for the driver."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ("search", "store", "vectors", "graphs", "model", "texts", "retrieval", "forms", "sync", "streams")


def collected() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for subject in SUBJECTS:
        module = import_module(f"{__name__}.{subject}")
        queries |= module.QUERIES
        oracle |= module.ORACLE_SQL
    return queries, oracle
