"""Registry of the retail queries: a Spark plan and its SQL under one key."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from mercata.sources.star import Star

from .oracle import LAYERS

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("layers", "library", "bi", "analytics", "forecasting", "text", "tables")
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a function of the star under ``key``; ``sql`` is the body of its SQL over the layers of ``oracle``."""

    def add(build: Callable[[Star], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(Star(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
            ORACLE[key] = f"WITH {recursive}{LAYERS}{',' + body[4 + len(recursive):] if body.upper().startswith('WITH') else body}"
        return build

    return add


def alias(key: str, of: str) -> None:
    """The same query under a second key of the inventory."""
    QUERIES[key], ORACLE[key] = QUERIES[of], ORACLE[of]


def _load() -> None:
    for name in MODULES:
        import_module(f"mercata.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
