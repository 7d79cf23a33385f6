"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""
from __future__ import annotations

import importlib

from .common import ORACLES, QUERIES

MODULES = ("decontamination", "secrets", "extraction", "neardup", "chat", "binary", "toxicity", "language", "packing", "rules", "negatives", "licenses", "infill")


def load() -> tuple[dict, dict[str, str]]:
    """The registered queries and their SQL."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
