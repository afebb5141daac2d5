"""Connected and strongly connected components and closures of edges, as loops of joins over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.storage import checkpointed


def digest(df: DataFrame) -> tuple:
    """A fingerprint of a set of rows: their count and sums of two hashes."""
    hashes = [F.sum(F.xxhash64(*df.columns, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(df.agg(F.count("*"), *hashes).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), read in both directions; a component is named by its least node.

    Large stars and small stars in turn: each node's greater neighbours are tied to the least node around it, then its
    smaller ones and itself. Stars of all depths become one in a number of rounds that grows with the logarithm of the
    nodes; the edges never grow. A neighbourhood is a grouped minimum and a join, never a list.
    """
    every = edges.where("a is not null and b is not null")
    nodes = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
    pairs = checkpointed(every.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := digest(pairs)) != before:
        before = now
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large, "large-stars")  # each edge (a, b) has b < a
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        pairs = checkpointed(small, "small-stars")
    return nodes.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reachable(edges: DataFrame) -> DataFrame:
    """All pairs (a, b) with a path of one edge or more from a to b, by semi-naive evaluation: each round extends only the
    pairs that the round before found, and keeps those that are new."""
    edges = checkpointed(edges.select("a", "b").dropna().distinct(), "edges")
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    found = delta = edges
    while not delta.isEmpty():
        longer = delta.join(step, "b").select("a", F.col("c").alias("b")).distinct()
        delta = checkpointed(longer.join(found, ["a", "b"], "left_anti"), "delta")
        found = found.union(delta)
    return found


def strong(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components of directed edges (a, b), named by their greatest node.

    First nodes without edges in or out drop off, round by round, as components of their own. Then each node takes the
    greatest node that reaches it; what reaches that node backwards within the same mark is its component; and the rest
    begins again. Every loop joins only what changed.
    """
    edges = checkpointed(edges.select("a", "b").dropna().distinct(), "edges")
    nodes = checkpointed(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    done = nodes.limit(0).withColumn("component", F.col("node"))
    while not nodes.isEmpty():
        while True:
            inner = edges.where("a <> b")
            on_path = inner.select(F.col("a").alias("node")).distinct().intersect(inner.select(F.col("b").alias("node")).distinct())
            trimmed = checkpointed(nodes.join(on_path, "node", "left_anti"), "trimmed")
            if trimmed.isEmpty():
                break
            done = done.union(trimmed.withColumn("component", F.col("node")))
            nodes, edges = _left(nodes, edges, trimmed)
        if nodes.isEmpty():
            break
        marks = changed = checkpointed(nodes.withColumn("mark", F.col("node")), "marks")
        while not changed.isEmpty():
            sent = edges.join(changed.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("mark").alias("other"))
            changed = checkpointed(marks.join(sent, "node").where("other > mark").select("node", F.col("other").alias("mark")), "changed")
            marks = checkpointed(marks.join(changed.withColumnRenamed("mark", "other"), "node", "left").select("node", F.coalesce("other", "mark").alias("mark")), "marks")
        # Edges within one mark, backwards from the node that gave it.
        ends = [marks.select(F.col("node").alias(c), F.col("mark").alias(f"m{c}")) for c in "ab"]
        within = checkpointed(edges.join(ends[0], "a").join(ends[1], "b").where("ma = mb").select("a", "b"), "within")
        found = frontier = checkpointed(marks.where("node = mark").select("node", F.col("mark").alias("component")), "roots")
        while not frontier.isEmpty():
            back = within.join(frontier.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component").distinct()
            frontier = checkpointed(back.join(found, "node", "left_anti"), "frontier")
            found = found.union(frontier)
        found = checkpointed(found, "strong")
        done = done.union(found)
        nodes, edges = _left(nodes, edges, found.select("node"))
    return done


def _left(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of some nodes."""
    kept = edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    return checkpointed(nodes.join(gone, "node", "left_anti"), "nodes"), checkpointed(kept.select("a", "b"), "edges")


def closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """(a, b) for every path from a to b. Strongly connected components are contracted first, so a cycle costs its members
    and not its paths; then the pairs of components are found semi-naively and written out for their members. A node on a
    cycle reaches itself; with `reflexive` every node does."""
    edges = checkpointed(edges.select("a", "b").dropna().distinct(), "edges")
    of = checkpointed(strong(edges), "components")
    ends = [of.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    placed = edges.join(ends[0], "a").join(ends[1], "b")
    between = placed.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    cyclic = placed.where("ca = cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    pairs = checkpointed(reachable(between).union(cyclic), "pairs")
    members = [of.select(F.col("component").alias(f"c{c}"), F.col("node").alias(c)) for c in "ab"]
    found = pairs.toDF("ca", "cb").join(members[0], "ca").join(members[1], "cb").select("a", "b")
    loops: Column = F.col("node")
    return found.union(of.select(loops.alias("a"), loops.alias("b"))).distinct() if reflexive else found
