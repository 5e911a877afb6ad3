"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postloom.plans.views import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the derived views."""
    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return add


def _runner(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Views(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(build) for name, build in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    from postloom.plans import (  # noqa: F401
        extraction, functions, ingestion, listings, matches, tables,
    )
