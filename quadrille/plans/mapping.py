"""Relational tables seen as RDF graphs.

A table is a class; a row is a resource `<base><table>/<key>`; a column is a property `<base><column>`; a foreign key's
value is the resource that it refers to. A star of properties of one subject is one scan of the table, with filters and
columns pushed down to it, and values stay native until they must be written as terms.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.quads import Graph, Part
from quadrille.plans.solutions import Solutions, union_all
from quadrille.terms import RDF, XSD, iri_column, literal_column

BASE = "http://example.org/"

#: Rows that a task unpivots or turns into terms, about: a few MB of a file may hold millions of rows.
TASK_ROWS = 100_000

#: XSD datatype of a Spark type.
_XSD = {"int": "int", "bigint": "long", "double": "double", "timestamp": "dateTime", "boolean": "boolean", "date": "date"}


@dataclass(frozen=True)
class TableMap:
    """key: column of the subject's IRI (None: each row is a blank node); links: foreign key column -> table that it
    refers to; lang: text column -> column of its language tag; left_out: columns without an RDF form."""

    key: str | None
    links: dict[str, str] = field(default_factory=dict)
    lang: dict[str, str] = field(default_factory=dict)
    left_out: tuple[str, ...] = ()


TABLES = {
    "region": TableMap("r_regionkey"),
    "nation": TableMap("n_nationkey", {"n_regionkey": "region"}),
    "customer": TableMap("c_custkey", {"c_nationkey": "nation"}),
    "supplier": TableMap("s_suppkey", {"s_nationkey": "nation"}),
    "part": TableMap("p_partkey"),
    "orders": TableMap("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": TableMap(None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": TableMap("event_id", {"user_id": "customer"}),
    "documents": TableMap("doc_id", lang={"text": "lang"}),
    "labels": TableMap("doc_id"),
    "benchmark": TableMap("item_id"),
}
#: Tables whose rows describe the resources of another table.
SUBJECTS = {"labels": "documents"}


@dataclass(frozen=True)
class TableGraph:
    spark: SparkSession
    folder: str
    base: str = BASE

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> DataFrame:
        """A table for work that makes much of a row: dealt to as many tasks as its rows ask for, however few files it has."""
        df = self.table(name)
        tasks = -(-df.count() // TASK_ROWS)
        return df.repartition(tasks, *([TABLES[name].key] if name in TABLES and TABLES[name].key else [])) if tasks > 1 else df

    def prefix(self, table: str) -> str:
        return f"{self.base}{SUBJECTS.get(table, table)}/"

    def star(self, table: str, subject: str | None = None, **properties: str) -> Solutions:
        """Patterns with one subject: subject is its variable, properties maps columns to variables."""
        spec = TABLES[table]
        columns, iris = [], {}
        if subject is not None and spec.key is not None:
            columns.append(F.col(spec.key).alias(subject))
            iris[subject] = self.prefix(table)
        for column, variable in properties.items():
            columns.append(F.col(column).alias(variable))
            if column in spec.links:
                iris[variable] = self.prefix(spec.links[column])
        df = self.table(table)
        required = [c for c in properties if c != spec.key]
        return Solutions(reduce(DataFrame.where, [F.col(c).isNotNull() for c in required], df).select(*columns), iris)

    def _term(self, table: str, column: str, kind: str) -> Column:
        spec, value = TABLES[table], F.col(column)
        if column in spec.links:
            return iri_column(F.concat(F.lit(self.prefix(spec.links[column])), value.cast("string")))
        if column in spec.lang:
            return literal_column(value, lang=F.col(spec.lang[column]))
        if kind == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return literal_column(value, datatype=XSD[_XSD[kind]] if kind in _XSD else None)

    def triples(self, table: str, *columns: str) -> Solutions:
        """?s ?p ?o over a table with a key: each row read once and unpivoted to one row per property, and its class. With
        columns, only their properties (`a` is the class): the scan reads these columns alone."""
        spec = TABLES[table]
        df = self.rows(table)
        subject = iri_column(F.concat(F.lit(self.prefix(table)), F.col(spec.key).cast("string")))
        own = [(c, kind) for c, kind in df.dtypes if c != spec.key and c not in spec.left_out and not kind.startswith("array")]
        if unknown := set(columns) - {c for c, _ in own} - {"a"}:
            raise ValueError(f"{table} has no properties {sorted(unknown)}")
        pairs = [F.struct(F.lit(f"<{self.base}{c}>").alias("p"), self._term(table, c, kind).alias("o")) for c, kind in own if not columns or c in columns]
        if table not in SUBJECTS and (not columns or "a" in columns):
            pairs.append(F.struct(F.lit(RDF.type).alias("p"), F.lit(f"<{self.base}{table}>").alias("o")))
        return Solutions(df.select(subject.alias("s"), F.inline(F.array(*pairs))).where(F.col("o").isNotNull()))

    def pattern(self, table: str, s: Part, p: str, o: Part) -> Solutions:
        """A triple pattern over a table with a constant predicate: one column of its scan, or its class."""
        column = "a" if p == RDF.type else p[len(self.base) + 1 : -1]
        return self.graph(table, column).pattern(s, p, o)

    def graph(self, table: str, *columns: str, name: str | None = None) -> Graph:
        """The table's quads, of these columns only if there are any, in the graph of that name or the default graph."""
        return Graph(self.triples(table, *columns).df.select(F.lit(name).cast("string").alias("g"), "s", "p", "o"))

    def materialize(self, *tables: str, graphs: bool = False) -> Graph:
        """Tables as quads, in the default graph, or each in the named graph `<base>graph/<table>`."""
        parts = [Solutions(self.graph(t, name=f"<{self.base}graph/{t}>" if graphs else None).df) for t in tables]
        return Graph(union_all(parts).df)
