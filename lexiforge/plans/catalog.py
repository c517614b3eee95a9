"""All registered queries of the engine and the SQL that each must match."""

from __future__ import annotations

_MODULES: tuple[str, ...] = ("text_plans", "token_plans", "lexicon_plans", "compare_plans", "store_plans", "error_plans", "vector_plans", "io_plans", "office_plans")


def _found(kind: str) -> dict:
    import importlib

    out: dict = {}
    for name in _MODULES:
        out |= getattr(importlib.import_module(f"lexiforge.plans.{name}"), kind)
    return out


def queries() -> dict:
    return _found("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _found("ORACLE")
