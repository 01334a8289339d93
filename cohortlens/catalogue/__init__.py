"""Every query by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from importlib import import_module

from cohortlens.session import ship, tuned

MODULES = ["tables", "scoring", "analysis", "models"]


def in_session(query):
    """The query in a session that is tuned and whose executors have this package."""
    return lambda spark, sf_dir: query(ship(tuned(spark)), sf_dir)


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"cohortlens.catalogue.{name}").QUERIES)
    return {name: in_session(query) for name, query in found.items()}
