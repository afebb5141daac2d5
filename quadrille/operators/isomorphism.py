"""Equality of graphs up to the names of their blank nodes.

Two sets with the same quads, labels included, are equal, and sets whose quads without blank nodes differ are not; one
grouping tells. What is left are the quads with blank nodes, those of both graphs in one table, so that each step runs once.

Blank nodes are coloured by what stands around them. Their quads without other blank nodes give the first colour; then in
each round a node's colour becomes a hash of its colour and of the sum of hashes of its tied quads (those with two blank nodes
or more) with the colours of the others in them. The sum needs no list of a node's quads, so a node with many is no trouble.
Rounds end when the number of colours stands still. If the two graphs have other numbers of nodes of some colour, they differ.

Nodes with a colour of their own then have a name, and quads in which at most one node has none are told by the colours of
their nodes. The nodes of the other quads fall into connected parts. A part in which no two nodes share a colour is told by
its quads, with colours for names. In any other part one of the nodes that share a colour is set apart, in a copy of the part
for each choice, and colouring goes on in all copies at once; the least of the copies' digests tells the part. Two graphs are
equal if the digests of their parts are, with their counts. Digests are sums of two 64-bit hashes and a count.

Parts that are very alike in themselves (cliques, regular grids) take many copies; beyond MOST_COPIES it is an error, not a
wrong answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import is_blank
from quadrille.operators.components import connected
from quadrille.storage import checkpointed

PLACES = ("g", "s", "o")
MOST_COPIES = 1_000_000
_SUMS = ("h1", "l1", "h2", "l2")


class TooAlike(RuntimeError):
    """The graph's blank nodes are so alike that telling them apart would take too many copies."""


def _blank(place: str) -> Column:
    return F.coalesce(is_blank(F.col(place)), F.lit(False))


def _nodes() -> Column:
    """The different blank nodes of a quad."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(_blank(p), F.col(p)) for p in PLACES])))


def _sums(*columns: Column, where: Column | None = None) -> list[Column]:
    """Sums of two hashes, of each its upper and its lower half, which plain integers hold."""
    halves = []
    for seed in (1, 2):
        h = F.xxhash64(*columns, F.lit(seed))
        halves += [F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))]
    return [F.sum(h if where is None else F.when(where, h).otherwise(0)).alias(name) for name, h in zip(_SUMS, halves, strict=True)]


def _colour(*columns: str) -> Column:
    return F.concat(*[F.hex(F.xxhash64(*columns, F.lit(seed))) for seed in (3, 4)])


def _named(quads: DataFrame, colours: DataFrame) -> DataFrame:
    """quads with what each place is called: its term, or its blank node's colour."""
    own = colours.select("copy", F.col("node").alias("_node"), F.col("colour").alias("_colour"))
    for place in PLACES:
        # Terms have no partner; each looks for one of its own, so that one that comes up often is no hot key.
        key = F.when(_blank(place), F.col(place)).otherwise(F.concat(F.lit(" "), F.xxhash64("g", "s", "p", "o")))
        quads = quads.withColumn("_node", key).join(own, ["copy", "_node"], "left").withColumn(f"_{place}", F.coalesce("_colour", place, F.lit(""))).drop("_node", "_colour")
    return quads


def _start(quads: DataFrame) -> DataFrame:
    """(copy, node, colour) by the quads of each node that have no other."""
    called = [F.when(_blank(p), "_:").otherwise(F.coalesce(F.col(p), F.lit(""))) for p in PLACES]
    rows = quads.select("*", F.explode(_nodes()).alias("node"))
    return rows.groupBy("copy", "node").agg(*_sums(F.col("p"), *called, where=F.size(_nodes()) == 1)).select("copy", "node", _colour(*_SUMS).alias("colour"))


def _refined(tied: DataFrame, colours: DataFrame) -> DataFrame:
    """One round of colours, for all copies at once."""
    here = [F.when(_blank(p), F.struct(F.col(p).alias("node"), F.lit(p).alias("place"))) for p in PLACES]
    alike = F.concat_ws(",", *[(F.col(a).eqNullSafe(F.col(b))).cast("string") for a, b in (("g", "s"), ("g", "o"), ("s", "o"))])
    seen = _named(tied, colours).select("copy", F.explode(F.array_compact(F.array(*here))).alias("n"), "p", *[f"_{p}" for p in PLACES], alike.alias("alike"))
    around = seen.groupBy("copy", F.col("n.node").alias("node")).agg(*_sums(F.col("n.place"), F.col("p"), *[F.col(f"_{p}") for p in PLACES], F.col("alike")))
    return colours.join(around, ["copy", "node"], "left").select("copy", "node", _colour("colour", *_SUMS).alias("colour"))


def _stable(tied: DataFrame, colours: DataFrame) -> DataFrame:
    """Colours after rounds until their number, within copies, stands still."""
    count = lambda df: df.select("copy", "colour").distinct().count()
    nodes, kinds = colours.count(), count(colours)
    while True:
        colours = checkpointed(_refined(tied, colours), "colours")
        before, kinds = kinds, count(colours)
        if kinds in (before, nodes):
            return colours


def _digests(quads: DataFrame, colours: DataFrame) -> DataFrame:
    """(copy, n, sums) of each copy's quads under colours for names."""
    named = _named(quads, colours)
    return named.groupBy("copy").agg(F.count("*").alias("n"), *_sums(F.col("p"), *[F.col(f"_{p}") for p in PLACES]))


def _tell(quads: DataFrame, colours: DataFrame) -> DataFrame:
    """(part, d): a digest of each part that does not depend on its nodes' labels."""
    found = None
    of = quads.select("copy").distinct().withColumn("part", F.col("copy"))
    while True:
        sizes = colours.groupBy("copy", "colour").agg(F.count("*").alias("n"))
        unclear = checkpointed(sizes.where("n > 1").groupBy("copy").agg(F.min("colour").alias("colour")), "unclear")
        clear = quads.join(unclear, "copy", "left_anti")
        digests = checkpointed(_digests(clear, colours).join(of, "copy").groupBy("part").agg(F.min(F.struct("n", *_SUMS)).alias("d")), "digests")
        found = digests if found is None else found.union(digests)
        if unclear.isEmpty():
            break
        # A copy for each node that could be set apart.
        choices = unclear.join(colours, ["copy", "colour"]).select("copy", F.col("node").alias("apart"), F.concat("copy", F.lit("|"), F.col("node")).alias("again"))
        choices = checkpointed(choices, "choices")
        if choices.count() > MOST_COPIES:
            raise TooAlike(f"more than {MOST_COPIES} copies of parts of a graph")
        quads = checkpointed(quads.join(choices, "copy").select(F.col("again").alias("copy"), "g", "s", "p", "o"), "copies")
        of = checkpointed(of.join(choices, "copy").select(F.col("again").alias("copy"), "part"), "copies")
        apart = F.when(F.col("node") == F.col("apart"), F.concat("colour", F.lit("!"))).otherwise(F.col("colour"))
        split = colours.join(choices, "copy").select(F.col("again").alias("copy"), "node", apart.alias("colour"))
        colours = _stable(quads, checkpointed(split, "colours"))
    return found.groupBy("part").agg(F.min("d").alias("d"))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, s, p, o, alone): the quads of two sets, and whether only one of them has it. Both are grouped once, nothing is joined."""
    own = lambda df, side: df.select("g", "s", "p", "o", F.lit(side).alias("side"))
    sides = own(a, 1).union(own(b, 2)).groupBy("g", "s", "p", "o").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    return sides.select("g", "s", "p", "o", (F.col("least") == F.col("most")).alias("alone"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The quads without blank nodes that only one of two sets has."""
    ground = ~_blank("g") & ~_blank("s") & ~_blank("o")
    return _sides(a.where(ground), b.where(ground)).where("alone").select("g", "s", "p", "o")


def _uneven(rows: DataFrame, *columns: str) -> bool:
    """Whether the two graphs (rows' `side`) have other numbers of rows of some kind."""
    kinds = rows.groupBy(*columns).agg(F.sum(F.when(F.col("side") == "1", 1).otherwise(-1)).alias("more"))
    return not kinds.where("more <> 0").isEmpty()


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of quads (g, s, p, o) are equal up to the labels of their blank nodes."""
    ground = ~_blank("g") & ~_blank("s") & ~_blank("o")
    other = _sides(a, b).agg(F.max("alone").alias("any"), F.max(F.col("alone") & ground).alias("ground")).first()
    if other["ground"] or not other["any"]:
        return not other["any"]
    # Labels tell the side, and the copies of parts are named after labels.
    label = lambda p, side: F.when(_blank(p), F.concat(F.lit(f"_:{side}"), F.substr(p, F.lit(3)))).otherwise(F.col(p)).alias(p)
    own = lambda df, side: df.where(~ground).select("g", "s", "p", "o").distinct().select(F.lit(side).alias("copy"), label("g", side), label("s", side), "p", label("o", side))
    quads = checkpointed(own(a, "1").union(own(b, "2")), "blank")
    colours = checkpointed(_start(quads), "colours")
    uneven = lambda df: _uneven(df.withColumn("side", F.col("copy")), "colour")
    if uneven(colours):
        return False
    tied = checkpointed(quads.where(F.size(_nodes()) > 1), "tied")
    if tied.isEmpty():
        return True
    colours = _stable(tied, colours)
    if uneven(colours):
        return False
    # Nodes that share their colour are open; all others have it for a name from now on.
    shared = colours.groupBy("copy", "colour").agg(F.count("*").alias("n")).where("n > 1").select("copy", "colour")
    names = colours.join(shared, ["copy", "colour"], "left_anti")
    settled = _named(tied, names).select("copy", F.col("_g").alias("g"), F.col("_s").alias("s"), "p", F.col("_o").alias("o"))
    settled = checkpointed(settled.where(F.size(_nodes()) > 1), "settled")
    edges = [settled.where(_blank(x) & _blank(y)).select(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("s", "o"), ("g", "s"), ("g", "o"))]
    of = checkpointed(connected(reduce(DataFrame.union, edges).distinct()), "parts")
    first = F.coalesce(*[F.when(_blank(p), F.col(p)) for p in PLACES])
    placed = settled.withColumn("node", first).join(of, "node").select(F.col("component").alias("copy"), "g", "s", "p", "o")
    known = of.join(colours.drop("copy"), "node").select(F.col("component").alias("copy"), "node", "colour")
    told = _tell(checkpointed(placed, "placed"), checkpointed(known, "colours"))
    return not _uneven(told.withColumn("side", F.substr("part", F.lit(3), F.lit(1))), "d")
