"""Name -> (bound query, DuckDB oracle SQL) registry.

A bound query takes ``(spark, sf_dir)``, reads the fixture tables through
:mod:`quarry.plans.bindings` and calls one library operator.  The SQL twin
runs on DuckDB over the same Parquet files; ``None`` marks operators that
have no SQL form (stateful folds, iterative algorithms).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
