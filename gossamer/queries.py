"""Registry of the core queries: name to (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["skew", "graphs", "web"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        found |= import_module(f"gossamer.plans.{m}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= import_module(f"gossamer.plans.{m}").SQL
    return found
