"""Named queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import ORACLES, QUERIES

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLES", "QUERIES"]
