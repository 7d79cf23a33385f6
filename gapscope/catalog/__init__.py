"""Queries over the given tables, one per operator or job."""
from __future__ import annotations

import importlib

from .core import REGISTRY, Entry

MODULES = ("history", "market", "research", "ledger", "streams", "composites", "landing")


def load_registry() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
