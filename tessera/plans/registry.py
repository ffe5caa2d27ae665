"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["tessera.plans.outcome_queries", "tessera.plans.molecule_queries", "tessera.plans.position_queries", "tessera.plans.relation_queries", "tessera.plans.source_queries", "tessera.plans.skew_and_files"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in import_module(m).ORACLE.items()}
