"""All queries of the engine by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from .. import plans


def _families():
    return [import_module(f"{plans.__name__}.{m.name}") for m in iter_modules(plans.__path__) if m.name.startswith("q_")]


def queries() -> dict:
    return {k: f for m in _families() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _families() for k, s in m.SQL.items()}
