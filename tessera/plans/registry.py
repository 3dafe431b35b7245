"""Registries: queries with their SQL, and operators by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql is the same for DuckDB."""

    def add(function: Query) -> Query:
        if function.__name__ in QUERIES:
            raise KeyError(f"query {function.__name__} is registered twice")
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


class Registry:
    """Named functions; a name can be taken once. Parameters are read from signatures."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str) -> Callable:
        def add(function: Callable) -> Callable:
            if name in self.entries:
                raise KeyError(f"{self.kind} {name} is registered twice")
            self.entries[name] = function
            return function

        return add

    def parameters(self, name: str) -> set[str]:
        return set(inspect.signature(self.entries[name]).parameters)

    def apply(self, name: str, df: DataFrame, **params: Any) -> DataFrame:
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name}; known are {sorted(self.entries)}")
        unknown = set(params) - self.parameters(name)
        if unknown:
            raise ValueError(f"{self.kind} {name} has no parameters {sorted(unknown)}")
        return self.entries[name](df, **params)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
