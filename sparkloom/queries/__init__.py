"""Registered queries: one for each operator, with DuckDB SQL where SQL expresses the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.shipping import ship
from sparkloom.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("relational", "scalars", "statistics", "profiling", "timeseries", "learning", "markets", "plots", "streams", "tables", "dialect")


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(t) -> DataFrame over the tables t of a folder."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return put


def load() -> None:
    for m in MODULES:
        import_module(f"sparkloom.queries.{m}")
