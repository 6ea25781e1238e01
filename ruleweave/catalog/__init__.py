"""All operators as named queries on the driver tables."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, Query

MODULES = (
    "prep_queries",
    "coverage_queries",
    "utility_queries",
    "relational_queries",
    "clause_queries",
    "model_queries",
    "learn_queries",
    "text_queries",
)


def _load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
