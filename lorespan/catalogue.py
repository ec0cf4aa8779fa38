"""All queries of the core, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name -> function of session and folder) and ``SQL`` (name -> text for DuckDB).
MODULES = ("lorespan.plans.search", "lorespan.plans.graph", "lorespan.plans.claims", "lorespan.plans.evidence", "lorespan.plans.pages", "lorespan.plans.text", "lorespan.plans.blocks", "lorespan.plans.logs", "lorespan.plans.streams", "lorespan.plans.orphans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= importlib.import_module(module).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= importlib.import_module(module).SQL
    return found
