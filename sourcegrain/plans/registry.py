"""Named queries. Each one is a Spark job over the driver tables and, where possible, DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    items: str  # survey rows the query covers
    run: Runner
    sql: str | None


_QUERIES: dict[str, Query] = {}
_MODULES = ("scan", "incremental", "rules", "passages", "verify", "facts", "clones", "findings", "graph", "search", "qa",
            "remediate", "triage", "runs")


def query(name: str, items: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(fn: Runner) -> Runner:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, items, fn, sql)
        return fn
    return register


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"sourcegrain.plans.{module}")
    return dict(_QUERIES)
