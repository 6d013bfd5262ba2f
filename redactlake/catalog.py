"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from types import FunctionType

from pyspark.sql import Column, DataFrame, SparkSession

from .functions.deferred import resolved

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_PLANS = ("text", "values", "pages", "tables", "ledger", "learning", "streams", "policy", "search", "reading", "vaults", "frames")


def query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"two queries are named {name}")
    _QUERIES[name] = build
    if sql is not None:
        _SQL[name] = sql


def _column(c) -> Column:
    return c() if isinstance(c, FunctionType) else resolved(c)


def scalar(name: str, fixture: str, keep: tuple[str, ...] = ("id",), /, **cols: tuple[Column | Callable[[], Column], str]) -> None:
    """A query of columns over a fixture: each with its SQL."""
    from .plans.fixtures import frame, plain

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir, fixture).select(*keep, *(_column(c).alias(n) for n, (c, _) in cols.items()))

    query(name, build, f"WITH fx AS ({plain(fixture)}) SELECT {', '.join([*keep, *(f'{s} AS {n}' for n, (_, s) in cols.items())])} FROM fx")


def _load() -> None:
    # importing a module again does nothing; one that was imported by itself brings the others no queries
    for plan in _PLANS:
        importlib.import_module(f"{__package__}.plans.{plan}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
