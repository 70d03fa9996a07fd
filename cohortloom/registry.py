"""Queries over the driver tables and their SQL, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries.
PLANS = ("matrix", "labels", "cohorts", "splits", "metrics", "calibration", "resampling", "shift", "models", "texts", "streams", "experiments", "lookups", "inference", "pathway")


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with equivalent SQL where there is any."""

    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    for name in PLANS:
        import_module(f"cohortloom.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
