"""All registered queries of the retrieval operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _name in ("lexical", "vectors", "ranking", "evaluation", "lifecycle", "structure", "graph", "answers", "sources"):
    _module = import_module(f"quarrygrid.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
