"""The catalogue of queries that are checked against an oracle."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loreweave.plans.tables import Tables, for_duckdb


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register a query under ``name``; ``covers`` lists inventory ids."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name!r} registered twice")
        CATALOGUE[name] = Query(name, covers, fn, oracle)
        return fn

    return register


def load() -> dict[str, Query]:
    from loreweave.plans import catalog

    for module in sorted(m.name for m in pkgutil.iter_modules(catalog.__path__)):
        importlib.import_module(f"{catalog.__name__}.{module}")
    return CATALOGUE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        return lambda spark, sf_dir: q.build(Tables(spark, sf_dir))

    return {name: runner(q) for name, q in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: for_duckdb(q.oracle) for name, q in load().items() if q.oracle}
