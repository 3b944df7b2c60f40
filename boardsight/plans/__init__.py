"""Registered queries."""

import importlib
import pkgutil

from boardsight.plans.registry import QUERIES, SQL, Tables

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["QUERIES", "SQL", "Tables"]
