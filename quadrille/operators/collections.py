"""RDF lists and containers as arrays of term keys.

A list is a chain of rdf:first / rdf:rest triples of any length. Positions come from pointer doubling: each round joins
the chain with itself, so a list of n members takes log2(n) joins, not n. Round results are written to shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import is_literal
from quadrille.operators.quads import Graph
from quadrille.storage import checkpointed, unsent
from quadrille.terms import RDF


class CollectionError(ValueError):
    """A list node without exactly one first and rest, a literal rest, or a cycle."""


def list_errors(graph: Graph) -> DataFrame:
    """(node, problem): list nodes that are not well formed."""
    parts = graph.df.where(F.col("p").isin(RDF.first, RDF.rest)).select("s", "p", "o").distinct()
    is_ = lambda p: (F.col("p") == p).cast("int")
    counts = parts.groupBy(F.col("s").alias("node")).agg(
        F.sum(is_(RDF.first)).alias("firsts"), F.sum(is_(RDF.rest)).alias("rests"), F.max(is_literal(F.col("o")) & (F.col("p") == RDF.rest)).alias("literal")
    )
    problem = (
        F.when((F.col("node") == RDF.nil), F.lit("rdf:nil has members"))
        .when(F.col("firsts") != 1, F.lit("not exactly one rdf:first"))
        .when(F.col("rests") != 1, F.lit("not exactly one rdf:rest"))
        .when(F.col("literal"), F.lit("rdf:rest is a literal"))
    )
    return counts.select("node", problem.alias("problem")).where("problem is not null")


def cells(graph: Graph, heads: DataFrame, check: bool = True) -> DataFrame:
    """(node, cell, pos): the cells of the lists whose head is in the one column of `heads`, positions from 0."""
    if check and not (bad := list_errors(graph)).isEmpty():
        raise CollectionError(str(bad.first().asDict()))
    rest = graph.df.where(F.col("p") == RDF.rest).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    heads = heads.toDF("node").distinct()
    reached = checkpointed(heads.where(F.col("node") != RDF.nil).select("node", F.col("node").alias("cell"), F.lit(0).cast("long").alias("pos")))
    jump, width, n_cells = checkpointed(rest.where(F.col("b") != RDF.nil)), 1, rest.count()
    while width <= 2 * n_cells:
        further = reached.join(unsent(jump), reached.cell == jump.a).select("node", F.col("b").alias("cell"), (F.col("pos") + width).alias("pos"))
        grown = checkpointed(reached.union(further))
        if grown.count() == reached.count():
            return reached
        reached, width = grown, 2 * width
        ahead = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = checkpointed(jump.join(unsent(ahead), "b").select("a", F.col("c").alias("b")))
    if n_cells:
        raise CollectionError("a list has a cycle")
    return reached


def members(graph: Graph, heads: DataFrame, check: bool = True) -> DataFrame:
    """(node, pos, val): the members of the lists."""
    first = graph.df.where(F.col("p") == RDF.first).select(F.col("s").alias("cell"), F.col("o").alias("val")).distinct()
    return cells(graph, heads, check).join(unsent(first), "cell").select("node", "pos", "val")


def read_lists(graph: Graph, heads: DataFrame, check: bool = True) -> DataFrame:
    """(node, items array<string>): the lists as arrays; rdf:nil is the empty array."""
    found = members(graph, heads, check).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("m"))
    empty = F.when(F.col("node") == RDF.nil, F.array().cast("array<string>"))
    return heads.toDF("node").distinct().join(found, "node", "left").select("node", F.coalesce(F.transform("m", lambda x: x["val"]), empty).alias("items")).where("items is not null")


def heads(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(node, val): the first member of each list that is not empty, without walking the lists."""
    first = graph.df.where(F.col("p") == RDF.first).select(F.col("s").alias("node"), F.col("o").alias("val")).distinct()
    return nodes.toDF("node").distinct().join(first, "node")


def tails(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(node, tail): the node of the list after the first member."""
    rest = graph.df.where(F.col("p") == RDF.rest).select(F.col("s").alias("node"), F.col("o").alias("tail")).distinct()
    return nodes.toDF("node").distinct().join(rest, "node")


def items_at(graph: Graph, nodes: DataFrame, position: int) -> DataFrame:
    """(node, val): the member at a position from 0, of the lists that have one."""
    return members(graph, nodes).where(F.col("pos") == position).select("node", "val")


def lengths(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(node, n): how many members each list has; the empty list has 0."""
    found = cells(graph, nodes).groupBy("node").agg(F.count("*").alias("n"))
    all_ = nodes.toDF("node").distinct().join(found, "node", "left")
    return all_.select("node", F.coalesce("n", F.when(F.col("node") == RDF.nil, F.lit(0).cast("long"))).alias("n")).where("n is not null")


def map_lists(lists: DataFrame, member: Callable[[Column], Column]) -> DataFrame:
    """Lists (node, items) with every member changed; build_lists() makes them triples again."""
    return lists.select("node", F.transform("items", member).alias("items"))


def filter_lists(lists: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Lists (node, items) with the members that pass; a list without members is rdf:nil's, whatever its node was."""
    kept = F.filter("items", keep)
    return lists.select(F.when(F.size(kept) == 0, F.lit(RDF.nil)).otherwise(F.col("node")).alias("node"), kept.alias("items"))


def build_lists(lists: DataFrame) -> DataFrame:
    """Triples (s, p, o) of lists (node, items array): node is the head, further cells are labelled from it."""
    cell = lambda i: F.when(F.col("pos") + i == 0, F.col("node")).when(F.col("pos") + i == F.col("n"), F.lit(RDF.nil)).otherwise(
        F.concat(F.lit("_:c"), F.md5("node"), F.lit("x"), (F.col("pos") + i).cast("string"))
    )
    rows = lists.select("node", F.size("items").alias("n"), F.posexplode("items").alias("pos", "val"))
    pairs = F.array(
        F.struct(cell(0).alias("s"), F.lit(RDF.first).alias("p"), F.col("val").alias("o")), F.struct(cell(0).alias("s"), F.lit(RDF.rest).alias("p"), cell(1).alias("o"))
    )
    return rows.select(F.inline(pairs))


def list_frame(graph: Graph, heads: DataFrame) -> Graph:
    """All first / rest quads that the lists reach."""
    own = cells(graph, heads).select(F.col("cell").alias("s"))
    return Graph(graph.df.where(F.col("p").isin(RDF.first, RDF.rest)).join(own, "s", "left_semi").select("g", "s", "p", "o"))


def read_containers(graph: Graph) -> DataFrame:
    """(node, items): containers by rdf:_1, rdf:_2 ...; members after a gap are not part of them, and of several values at
    one ordinal all are, in order of their keys."""
    number = F.regexp_extract("p", r"#_([1-9]\d*)>$", 1).try_cast("long")
    rows = graph.df.where(F.startswith("p", F.lit(RDF["_"][:-1]))).select(F.col("s").alias("node"), number.alias("pos"), F.col("o").alias("val")).where("pos is not null").distinct()
    by_ordinal = rows.groupBy("node", "pos").agg(F.sort_array(F.collect_list("val")).alias("vals"))
    listed = by_ordinal.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "vals"))).alias("m"))
    dense = F.filter("m", lambda x, i: x["pos"] == i + 1)
    return listed.select("node", F.flatten(F.transform(dense, lambda x: x["vals"])).alias("items")).where(F.size("items") > 0)


def build_containers(lists: DataFrame) -> DataFrame:
    """Triples (s, p, o) of containers (node, items array)."""
    rows = lists.select(F.col("node").alias("s"), F.posexplode("items").alias("pos", "o"))
    return rows.select("s", F.concat(F.lit(RDF["_"][:-1]), (F.col("pos") + 1).cast("string"), F.lit(">")).alias("p"), "o")
