"""Queries over the test tables."""

from __future__ import annotations

import importlib
from types import ModuleType

#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("q_dedup", "q_catalog", "q_ingest", "q_search", "q_study", "q_nested", "q_store")


def load() -> ModuleType:
    """The registry, with all query modules imported."""
    for name in MODULES:
        importlib.import_module(f"leafmill.plans.{name}")
    return importlib.import_module("leafmill.plans.registry")
