"""Graphs of quads: a DataFrame (g, s, p, o) of term keys, g null in the default graph, without duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import is_blank
from quadrille.operators.isomorphism import isomorphic
from quadrille.plans.solutions import Solutions
from quadrille.storage import checkpointed
from quadrille.terms import RDF, as_key

COLUMNS = ["g", "s", "p", "o"]
SCHEMA = "g string, s string, p string, o string"
Part = str | int | float | bool | None


@dataclass(frozen=True)
class Graph:
    """An immutable set of quads. Set operations compare whole quads; has, get and patterns compare triples."""

    df: DataFrame

    @staticmethod
    def of(spark: SparkSession, triples: Iterable[Sequence], g: str | None = None) -> Graph:
        """A graph of a few triples, or quads (g, s, p, o), given in Python."""
        rows = [(*([g] if len(t) == 3 else []), *[x if x is None else as_key(x) for x in t]) for t in triples]
        return Graph(spark.createDataFrame(rows, SCHEMA).distinct())

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], SCHEMA))

    @staticmethod
    def from_triples(df: DataFrame, g: str | None = None) -> Graph:
        return Graph(df.select(F.lit(g).cast("string").alias("g"), "s", "p", "o").distinct())

    def _is(self, s: Part, p: Part, o: Part) -> Column:
        parts = [F.col(c) == as_key(x) for c, x in (("s", s), ("p", p), ("o", o)) if x is not None]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def get(self, s: Part = None, p: Part = None, o: Part = None) -> Graph:
        """The quads with these parts; None matches everything. The filters reach the Parquet scan."""
        return Graph(self.df.where(self._is(s, p, o)))

    def has(self, s: Part = None, p: Part = None, o: Part = None) -> bool:
        return not self.get(s, p, o).df.isEmpty()

    def contains(self, s: Part, p: Part, o: Part) -> bool:
        return self.has(s, p, o)

    def size(self) -> int:
        return self.df.count()

    def add(self, *triples: Sequence) -> Graph:
        return self | Graph.of(self.df.sparkSession, triples)

    def remove(self, *triples: Sequence) -> Graph:
        return self - Graph.of(self.df.sparkSession, triples)

    def __or__(self, other: Graph) -> Graph:
        return Graph(self.df.select(*COLUMNS).union(other.df.select(*COLUMNS)).distinct())

    def __sub__(self, other: Graph) -> Graph:
        return Graph(self.df.select(*COLUMNS).subtract(other.df.select(*COLUMNS)))

    def __and__(self, other: Graph) -> Graph:
        return Graph(self.df.select(*COLUMNS).intersect(other.df.select(*COLUMNS)))

    def same(self, other: Graph) -> bool:
        """Whether both have the same quads, whatever their blank nodes are called."""
        return isomorphic(self.df, other.df)

    def where(self, condition: Column) -> Graph:
        return Graph(self.df.where(condition))

    # Named graphs

    def default(self, *sources: str) -> Graph:
        """FROM: the merge of these graphs becomes the default graph; without sources, the default graph itself."""
        chosen = F.col("g").isin(list(sources)) if sources else F.col("g").isNull()
        return Graph(self.df.where(chosen).select(F.lit(None).cast("string").alias("g"), "s", "p", "o").distinct())

    def named(self, *graphs: str) -> Graph:
        """FROM NAMED: only these named graphs; without any, all named graphs."""
        return Graph(self.df.where(F.col("g").isin(list(graphs)) if graphs else F.col("g").isNotNull()))

    # Patterns

    def pattern(self, s: Part, p: Part, o: Part, graph: str | None = None) -> Solutions:
        """A triple pattern: "?x" is a variable, "_:x" a hidden one, everything else a key. `graph` is a key, or a
        variable that takes the name of the graph; None reads all quads of this Graph as one set of triples."""
        parts = {"s": s, "p": p, "o": o} | ({"g": graph} if graph is not None else {})
        df, columns = self.df, {}
        for column, part in parts.items():
            part = as_key(part)
            if part.startswith(("?", "_:")):
                columns.setdefault(part[1:] if part.startswith("?") else f"_b_{part[2:]}", []).append(column)
            else:
                df = df.where(F.col(column) == part)
        if graph is not None and graph.startswith("?"):
            df = df.where(F.col("g").isNotNull())
        for own in columns.values():
            for again in own[1:]:
                df = df.where(F.col(own[0]) == F.col(again))
        chosen = [F.col(own[0]).alias(name) for name, own in columns.items()]
        if not chosen:  # no variable: one empty solution if the triple is there
            return Solutions(df.limit(1).select(F.lit(True).alias("_there")))
        return Solutions(df.select(*chosen))

    def bgp(self, *patterns: Sequence, graph: str | None = None) -> Solutions:
        """A basic graph pattern: its triple patterns joined on shared variables, connected ones first."""
        todo = [self.pattern(*t, graph=graph) for t in patterns]
        found = todo.pop(0)
        while todo:
            at = next((i for i, t in enumerate(todo) if found._shared(t)), 0)
            found = found.join(todo.pop(at))
        return found

    def list_pattern(self, node: str, members: Sequence[str], prefix: str = "l") -> list[tuple[str, str, str]]:
        """A collection in a pattern as its first / rest triple patterns."""
        nodes = [node, *[f"_:{prefix}{i}" for i in range(1, len(members))], RDF.nil]
        return [t for i, m in enumerate(members) for t in ((nodes[i], RDF.first, m), (nodes[i], RDF.rest, nodes[i + 1]))]

    # Query forms on graphs

    def describe(self, resources: DataFrame) -> DataFrame:
        """DESCRIBE: triples whose subject is in the one column of `resources`, and those of blank nodes that they reach.
        Each round joins only subjects that are new, and is written down, so cycles end and lineage stays short."""
        triples = self.df.select("s", "p", "o")  # only what is found is made distinct
        todo = resources.toDF("s").distinct()
        seen, found = todo, None
        while True:
            step = triples.join(todo, "s")
            found = step if found is None else found.union(step)
            reached = step.where(is_blank(F.col("o"))).select(F.col("o").alias("s")).distinct()
            todo = checkpointed(reached.join(seen, "s", "left_anti"))
            if todo.isEmpty():
                return found.distinct()
            seen = seen.union(todo)


@dataclass(frozen=True)
class View:
    """A focus on a graph: the universe of triples, and the frame that the view is about."""

    triples: Graph
    frame: Graph

    def is_exact(self) -> bool:
        return self.triples.same(self.frame)

    def added_to(self, graph: Graph) -> Graph:
        return graph | self.frame

    def removed_from(self, graph: Graph) -> Graph:
        return graph - self.frame
