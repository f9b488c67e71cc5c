"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("conversations", "corpus", "datasets", "formats", "more", "rules", "training")


def queries() -> dict:
    return {k: q for m in MODULES for k, (q, _) in import_module(f"loomwright.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in import_module(f"loomwright.plans.{m}").QUERIES.items() if s}
