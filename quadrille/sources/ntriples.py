"""N-Triples and N-Quads: one statement a line, so Spark splits files anywhere and parses with its own functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.quads import Graph

_IRI, _BLANK = r"<[^<>\"{}|^`\\\x00-\x20]*>", r"_:[\w.-]*\w"
#: Possessive, so that Java's matcher does not recurse into long literals.
_LITERAL = rf'"(?:[^"\\\n\r]++|\\.)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?'
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


class ParseError(ValueError):
    """Text that is not RDF in the format asked for."""


@contextmanager
def parsing() -> Iterator[None]:
    """Around what reads the rows of a graph: bad text of any format, which Spark reports then, is a ParseError."""
    try:
        yield
    except Exception as e:
        found = re.search(r"(?:not a statement|not Turtle|undeclared prefix|no XML name): [^\n]*|(?<=ParseError: )[^\n]*", str(e))
        if found is None:
            raise
        raise ParseError(found.group()) from e


def statements(lines: DataFrame) -> DataFrame:
    """(g, s, p, o, line) of lines (value); where a line is not a statement s is null. Comments and blank lines go."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    g = F.when(part(4) != "", part(4))
    typed = F.regexp_replace(part(3), r'"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$', '"')
    return rows.select(g.alias("g"), F.when(part(1) != "", part(1)).alias("s"), part(2).alias("p"), typed.alias("o"), F.col("value").alias("line"))


def read(spark: SparkSession, *paths: str, strict: bool = True) -> Graph:
    """The quads of files. A bad line is an error when the rows are read, or is left out if not strict."""
    rows = statements(spark.read.text(list(paths)))
    checked = F.when(F.col("s").isNull(), F.raise_error(F.concat(F.lit("not a statement: "), "line"))).otherwise(F.col("s"))
    rows = rows.withColumn("s", checked) if strict else rows.where("s is not null")
    return Graph(rows.select("g", "s", "p", "o").distinct())


def lines(graph: Graph) -> DataFrame:
    """(value): a statement a line."""
    value: Column = F.concat_ws(" ", "s", "p", "o", "g", F.lit("."))
    return graph.df.select(value.alias("value"))


def write(graph: Graph, path: str, mode: str = "error") -> None:
    lines(graph).write.mode(mode).text(path)
