"""SQL text per query name for the side-by-side check."""

from __future__ import annotations

from importlib import import_module

MODULES = ["tables", "scoring", "analysis"]


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"oracles.{name}").ORACLES)
    return found
