"""Operators for preparing training data. Nothing else in the package imports this one."""

from __future__ import annotations

import importlib

_MODULES = ("topk", "mixing", "language", "quality", "pieces", "matroska", "simhash", "revisits", "licenses", "webtext")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    """Name to a function of (spark, sf_dir) that returns a DataFrame."""
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL over the same tables, where SQL can express the query."""
    return _merged("ORACLES")
