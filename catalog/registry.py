"""Registration of queries and of the views they read."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; without ``sql`` only its rows are checked by the driver."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark, os.path.dirname(__file__))
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


# Views: name -> (dependencies, SQL for DuckDB)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(body: str, *names: str) -> str:
    """Prefixes a query with the views it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n" + body
