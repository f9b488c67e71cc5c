"""All queries of the problems on training text, with the SQL of those SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("leaks", "mixing", "neardup", "packing", "pairs", "sentences", "truncation")


def load() -> list:
    """The modules of all problems; ``ImportError`` where a dependency is missing."""
    return [import_module(f"loomwright.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in load() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in load() for k, s in m.SQL.items()}
