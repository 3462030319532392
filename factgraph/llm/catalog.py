"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and, where SQL can express them, ORACLE.
_MODULES = ("simhash", "line_dedup", "ann", "decontaminate", "licenses", "quality", "substring_dedup", "html_text", "bpe", "language", "version_sketch", "merkle", "conversation_repair")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in import_module(f"factgraph.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(import_module(f"factgraph.llm.{m}"), "ORACLE", {}).items()}
