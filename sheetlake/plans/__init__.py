"""Registered queries and their DuckDB oracles."""

from importlib import import_module

MODULES = ("ingest", "headers", "curated", "service", "sql_suite", "workbooks", "tables")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        for name, entry in getattr(import_module(f"{__name__}.{module}"), attribute).items():
            if name in merged:
                raise ValueError(f"{name} is registered twice")
            merged[name] = entry
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
