"""Queries of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("chat", "winnow", "quality", "licences", "packing", "language", "html", "warc", "minhash", "mixing", "collocations", "alignment", "simhash")


def _modules():
    return [import_module(f"quillstage.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.SQL
    return out
