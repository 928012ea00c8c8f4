"""Runnable queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """(queries, sql) of every module named ``queries_*``."""
    from . import catalog
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod.startswith("queries_"):
            importlib.import_module(f"{__name__}.{mod}")
    return catalog.QUERIES, catalog.ORACLES
