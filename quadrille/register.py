"""Where queries are registered, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.mapping import BASE
from quadrille.terms import Namespace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EX = Namespace(BASE)


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def number(column: str, name: str | None = None) -> Column:
    """The key of a table's row from its IRI."""
    return F.regexp_extract(column, r"/(\d+)>$", 1).cast("long").alias(name or column)


def resource(table: str, key: Column) -> Column:
    """The IRI of a table's row."""
    return F.concat(F.lit(f"<{BASE}{table}/"), key.cast("string"), F.lit(">"))
