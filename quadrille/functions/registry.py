"""Functions called by IRI: XSD constructor casts, and what users register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.terms import XSD

_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_function(name: str, function: Callable[..., Column]) -> None:
    """`function` takes and returns columns; it may be a pandas UDF."""
    _FUNCTIONS[name] = function


def call(name: str, *arguments: Column) -> Column:
    """The function with this IRI (a key or bare text) applied to columns."""
    name = name.strip("<>")
    if name not in _FUNCTIONS:
        raise KeyError(f"no function is registered as {name}")
    return _FUNCTIONS[name](*arguments)


def _cast(kind: str) -> Callable[[Column], Column]:
    return lambda value: value.try_cast(kind)


for _name, _kind in {
    "integer": "decimal(38,0)",
    "decimal": "decimal(38,18)",
    "float": "float",
    "double": "double",
    "boolean": "boolean",
    "dateTime": "timestamp",
    "string": "string",
}.items():
    register_function(XSD[_name][1:-1], _cast(_kind))

register_function(XSD.date[1:-1], lambda value: F.to_date(value.try_cast("timestamp")))
