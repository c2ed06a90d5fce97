"""All registered queries."""

from __future__ import annotations

import importlib

from wayfare.plans.registry import REGISTRY, Query

MODULES = (
    "catalog_log",
    "catalog_snapshots",
    "catalog_transitions",
    "catalog_scores",
    "catalog_segments",
    "catalog_evaluation",
)


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        try:
            importlib.import_module(f"wayfare.plans.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"wayfare.plans.{name}":
                raise
    return dict(REGISTRY)
