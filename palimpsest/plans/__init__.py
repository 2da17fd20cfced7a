"""Views over the driver's tables and the queries registered on them."""

from __future__ import annotations

from importlib import import_module

from palimpsest.plans.registry import ORACLES, QUERIES

_MODULES = ("text", "metrics", "mining", "code", "beams", "vectors", "io")


def _load() -> None:
    for name in _MODULES:
        import_module(f"palimpsest.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(ORACLES)
