"""All queries of the core."""

from __future__ import annotations

from functools import cache
from importlib import import_module

from lodestrata.plans.registry import Registry

MODULES = ("references", "search", "text", "analytics", "graph", "evaluate", "content", "streams")


@cache
def registry() -> Registry:
    merged = Registry()
    for name in MODULES:
        merged.merge(import_module(f"lodestrata.plans.{name}").registry)
    return merged
