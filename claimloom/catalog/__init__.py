"""Runnable queries over the test tables, one or more per operator."""

import importlib

from claimloom.catalog.registry import ORACLES, QUERIES

MODULES = ["assembly", "reporting", "changes", "rulesets", "models", "boosting", "files", "streams"]
for _m in MODULES:
    importlib.import_module(f"claimloom.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]
