"""Collects the registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

MODULES = ["cleaning", "charts", "plans", "catalog", "sources", "context", "ml", "misc", "records"]


def _mods():
    return [importlib.import_module(f"millrace.checks.{m}") for m in MODULES]


def all_queries() -> dict:
    out = {}
    for m in _mods():
        for k, v in m.Q.items():
            assert k not in out, k
            out[k] = v
    return out


def all_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(m.SQL)
    return out
