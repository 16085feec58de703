"""One place where operator modules register their named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES: tuple[str, ...] = tuple(f"brindle.plans.{name}" for name in ("retrieval", "evaluation", "ingest", "relational", "events", "answers", "records", "tex", "imports", "loads"))


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL, only its row count is checked from outside and a test of ours does the rest."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def _load() -> None:
    for module in MODULES:
        import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
