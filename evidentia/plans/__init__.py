"""Queries of the operators over the driver's tables, each with its DuckDB oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("joining", "aggregating", "positions", "graphs", "testing", "scalars", "records")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        own = getattr(importlib.import_module(f"evidentia.plans.{name}"), attribute)
        if twice := found.keys() & own.keys():
            raise ValueError(f"queries named twice: {sorted(twice)}")
        found |= own
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
