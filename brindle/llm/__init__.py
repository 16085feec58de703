"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "lines", "quality", "chat", "neardup", "reputation", "pii", "fingerprint", "bpe", "langid", "secrets", "blockmax", "centroids")


def queries() -> dict:
    return {name: f for module in MODULES for name, f in import_module(f"brindle.llm.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(import_module(f"brindle.llm.{module}"), "ORACLE", {}).items()}
