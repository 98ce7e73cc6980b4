"""Collects the queries that the operator modules of this package declare.

A module declares ``QUERIES`` (name -> callable of spark and sf_dir) and, where
SQL can express the result, ``ORACLE_SQL`` (name -> DuckDB SQL).
"""

from __future__ import annotations

import pkgutil
from importlib import import_module

import tributary.llm


def _declared(attribute: str) -> dict:
    found: dict = {}
    for info in sorted(pkgutil.iter_modules(tributary.llm.__path__), key=lambda m: m.name):
        if info.name != "queries":
            found |= getattr(import_module(f"tributary.llm.{info.name}"), attribute, {})
    return found


def queries() -> dict:
    return _declared("QUERIES")


def oracle_sql() -> dict:
    return _declared("ORACLE_SQL")
