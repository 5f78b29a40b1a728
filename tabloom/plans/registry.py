"""Registry of the queries the driver runs: Spark plan + DuckDB oracle SQL.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole driver tables.  The SQL (when given) computes the same
relation in DuckDB over the pre-registered views; column names match.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, tuple[Callable, str | None]] = {}

_PLAN_MODULES = (
    "tabloom.plans.retrieval_plans",
    "tabloom.plans.ingest_plans",
    "tabloom.plans.link_plans",
    "tabloom.plans.table_plans",
    "tabloom.plans.quant_plans",
    "tabloom.plans.context_plans",
    "tabloom.plans.evaluate_plans",
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = (fn, sql)
        return fn
    return deco


def _load():
    for mod in _PLAN_MODULES:
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as exc:
            if exc.name != mod:
                raise


def queries() -> dict[str, Callable]:
    _load()
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
